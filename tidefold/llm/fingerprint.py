"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, from DataFrame functions only.

A paragraph is a line without the white space around it; blank lines are none. Its digest is 64 bits of its md5. A sketch has three tables
of WIDTH cells; each digest of a document goes to one cell of each table. A cell holds how many digests went there, their exclusive or, and
that of a check number of each. Sketches of two texts subtract cell by cell: what both hold vanishes. A cell that is left with one digest
(a count of 1 or -1, and the check fits) gives it away; taking it out of its other cells uncovers more, until nothing is left: the digests
that only the one text has and those that only the other has. If cells are left over, the sketch was too small for the difference: its digests are
split in two by a hash, each half gets a sketch of the full size with other places, and so on for the halves that fail.

likeness of two texts: digests in common / digests in all, from the recovered difference. The published fingerprint is the first sketch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import BLANKS
from .runtime import discard, spread, stored

#: Cells of a table (a power of two), tables, rounds of peeling after which a sketch counts as failed, and most times that a sketch is made larger.
WIDTH, TABLES, ROUNDS, MOST_LEVELS = 8, 3, 12, 60
#: Digests of both sides for which a failed sketch gets a part, and most parts at a time.
PART, MOST_PARTS = 8, 16
_BITS = WIDTH.bit_length() - 1
#: Constants of the check number (fixed values): ((high half * A + low half * B + C) mod P) squared mod P.
CHECK_A, CHECK_B, CHECK_C, CHECK_P = 715225741, 982451653, 122949829, 2147483647


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column) -> Column:
    """array<bigint>: the distinct paragraph digests of a text; null is empty."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    lines = F.array_distinct(F.filter(lines, lambda x: x != ""))
    return F.array_distinct(F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 16), 16, -10).cast("long")))


def _check(k: Column) -> Column:
    mixed = (F.shiftrightunsigned(k, 32) * CHECK_A + k.bitwiseAND(0xFFFFFFFF) * CHECK_B + CHECK_C) % CHECK_P
    return _let(mixed, lambda a: a * a % CHECK_P)


def _place(k: Column, table: int, level: int) -> Column:
    bits = k if level == 0 else F.xxhash64(k, F.lit(level))
    return F.shiftrightunsigned(bits, table * _BITS).bitwiseAND(WIDTH - 1)


def _cell(c: Column, k: Column, x: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), k.cast("long").alias("k"), x.cast("long").alias("x"))


_EMPTY = (0, 0, 0)


def sketch(keys: Column, level: int = 0) -> Column:
    """The cells of distinct digests, table after table: array<struct<c int, k bigint, x bigint>>."""
    zero = _cell(*map(F.lit, _EMPTY))
    add = lambda s, k: _cell(s["c"] + 1, s["k"].bitwiseXOR(k), s["x"].bitwiseXOR(_check(k)))
    places = F.sequence(F.lit(0), F.lit(WIDTH - 1))
    cells = lambda t: F.transform(places, lambda i: F.aggregate(F.filter(keys, lambda k: _place(k, t, level) == i), zero, add))
    return F.concat(*map(cells, range(TABLES)))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["c"] - y["c"], x["k"].bitwiseXOR(y["k"]), x["x"].bitwiseXOR(y["x"])))


def peeled(cells: Column, level: int = 0) -> Column:
    """struct(ok, mine, theirs): the digests that only the first and only the second of two subtracted sketches has; ok if nothing was left over."""
    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("mine"), F.array().cast("array<bigint>").alias("theirs"), F.lit(False).alias("stop"))

    def step(s: Column, _: Column) -> Column:
        single = lambda c: ((c["c"] == 1) | (c["c"] == -1)) & (c["x"] == _check(c["k"]))
        pure = F.array_distinct(F.filter(s["cells"], single))

        def taken(p: Column) -> Column:
            def rest(t: int) -> Column:
                out = lambda a, q, i: F.when(_place(q["k"], t, level) == i, _cell(a["c"] - q["c"], a["k"].bitwiseXOR(q["k"]), a["x"].bitwiseXOR(q["x"]))).otherwise(a)
                return F.transform(F.slice(s["cells"], t * WIDTH + 1, WIDTH), lambda c, i: F.aggregate(p, c, lambda a, q: out(a, q, i)))

            found = lambda sign: F.transform(F.filter(p, lambda q: q["c"] == sign), lambda q: q["k"])
            moved = F.struct(F.concat(*map(rest, range(TABLES))).alias("cells"), F.concat(s["mine"], found(1)).alias("mine"), F.concat(s["theirs"], found(-1)).alias("theirs"), (F.size(p) == 0).alias("stop"))
            return moved

        return F.when(s["stop"], s).otherwise(_let(pure, taken))

    done = lambda s: F.struct((~F.exists(s["cells"], lambda c: (c["c"] != 0) | (c["k"] != 0) | (c["x"] != 0))).alias("ok"), s["mine"].alias("mine"), s["theirs"].alias("theirs"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, done)


def written(cells: Column) -> Column:
    """A sketch as a string: count, digests and checks (hexadecimal) of each cell."""
    digits = lambda v, n: F.lpad(F.lower(F.hex(v)), n, "0")
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["c"].cast("string"), digits(c["k"], 16), digits(c["x"], 8))), ",")


def read(fingerprint: Column) -> Column:
    """The sketch of a written() string."""
    number = lambda s: F.conv(s, 16, -10).cast("long")
    return F.transform(F.split(fingerprint, ","), lambda s: _let(F.split(s, ":"), lambda p: _cell(p[0], number(p[1]), number(p[2]))))


def differences(pairs: DataFrame, key: str = "pair") -> DataFrame:
    """(pair, n_mine, n_theirs) of pairs(pair, mine, theirs): how many digests only the one side and only the other side of each pair has; mine, theirs: arrays of distinct digests.

    Sketches that fail are tried again with more cells, until none does: each level is a stored table of what the last one left."""
    spark = pairs.sparkSession
    done: list[DataFrame] = []
    left = pairs.select(F.col(key).alias("pair"), "mine", "theirs")
    for level in range(MOST_LEVELS):
        tried = left.withColumn("p", peeled(subtracted(sketch(F.col("mine"), level), sketch(F.col("theirs"), level)), level))
        part = lambda c: F.when(~F.col("p.ok"), F.col(c)).alias(c)
        tried = stored(spark, tried.select("pair", "p.ok", F.size("p.mine").alias("n_mine"), F.size("p.theirs").alias("n_theirs"), part("mine"), part("theirs")), "peeled")
        done.append(tried.where("ok").select("pair", "n_mine", "n_theirs"))
        failed = tried.where("not ok")
        if failed.isEmpty():
            break
        parts = F.least(F.lit(MOST_PARTS), F.greatest(F.lit(2), F.ceil((F.size("mine") + F.size("theirs")) / PART)))
        own = lambda c, n, level=level: F.filter(c, lambda k: F.pmod(F.xxhash64(k, F.lit(-1 - level)), F.col("parts")) == n).alias(c)
        split = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda n: F.struct(own("mine", n), own("theirs", n)))
        left = failed.withColumn("parts", parts).select("pair", F.explode(split).alias("s")).select("pair", "s.*")
    else:
        raise RuntimeError("digests that no sketch separates")
    found = reduce(DataFrame.unionByName, done)
    return found.groupBy("pair").agg(F.sum("n_mine").alias("n_mine"), F.sum("n_theirs").alias("n_theirs"))


def following(ids: DataFrame) -> DataFrame:
    """(id, next_id) of a table of distinct ids: the next smaller id; after the smallest, the largest. Ids meet in ranges; of ranges, only the ends meet."""
    spark = ids.sparkSession
    ranged = stored(spark, ids.select("id").repartitionByRange(spread(spark), F.desc("id")).withColumn("part", F.spark_partition_id()), "ranges")
    order = Window.orderBy("part")  # one row a range
    ends = ranged.groupBy("part").agg(F.max("id").alias("top"))
    ends = ends.select(F.col("part").alias("e_part"), F.coalesce(F.lead("top").over(order), F.max("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    within = F.lead("id").over(Window.partitionBy("part").orderBy(F.desc("id")))
    return ranged.join(F.broadcast(ends), F.col("part") == F.col("e_part")).select("id", F.coalesce(within, "after").alias("next_id"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points (rounded down) replaced by the first as many of the next document, in descending id, the first after the
    last. near_ are likenesses (0 to 1) to the edited text and to the next document; two texts without paragraphs are alike (1). A null text is empty. Each row is
    judged for itself. Rows that repeat an id have the same next document; as a next document, the smallest of their texts stands for them. Rows without an id are no
    one's next document and have none: their edited text is their first half, near_next is null. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    half = F.floor(F.char_length("text") / 2)
    live = texts.where("id is not null")
    ids = stored(spark, live.groupBy("id").agg(F.max(half).cast("int").alias("need"), F.count("*").alias("n")), "ids")
    link = following(ids).join(ids.select("id", "need"), "id").select(F.col("id").alias("of"), F.col("next_id").alias("id"), "need")
    # where ids are unique, both joins read the same shuffled texts
    standing = live if ids.where("n > 1").isEmpty() else live.groupBy("id").agg(F.min("text").alias("text"))
    heads = standing.join(link, "id").select(F.col("of").alias("id"), F.left("text", F.col("need")).alias("head"), digests(F.col("text")).alias("after"))
    both = live.join(heads, "id").select("id", "text", "head", "after")
    both = both.unionByName(texts.where("id is null"), allowMissingColumns=True)
    both = both.withColumn("half", half.cast("int")).withColumn("n_chars", F.char_length("text"))
    edited = F.concat(F.left("text", F.col("n_chars") - F.col("half")), F.left(F.coalesce("head", F.lit("")), F.col("half")))
    both = both.select("id", F.col("n_chars").cast("long").alias("n_chars"), digests(F.col("text")).alias("mine"), edited.alias("edited"), "after")
    rows = both.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "mine", digests(F.col("edited")).alias("edited"), "after")
    rows = stored(spark, rows.withColumn("row", F.monotonically_increasing_id()), "digests")

    sides = F.array(F.struct(F.lit(0).alias("which"), F.col("edited").alias("theirs")), F.struct(F.lit(1).alias("which"), F.col("after").alias("theirs")))
    pairs = rows.select("row", "mine", F.explode(sides).alias("s")).where("s.theirs is not null").select(F.struct("row", "s.which").alias("pair"), "mine", "s.theirs")
    found = differences(pairs).select("pair.*", "n_mine", "n_theirs")
    of = lambda k, c: F.max(F.when(F.col("which") == k, F.col(c)))
    found = found.groupBy(F.col("row").alias("f_row")).agg(*[of(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("n_mine", "n_theirs")])
    whole = F.size("mine")
    near = lambda k: F.when(whole + F.col(f"n_theirs{k}") == 0, F.lit(1.0)).otherwise((whole - F.col(f"n_mine{k}")) / (whole + F.col(f"n_theirs{k}")))
    out = rows.join(found, F.col("row") == F.col("f_row"))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", written(sketch(F.col("mine"))).alias("fingerprint"), written(sketch(F.col("edited"))).alias("edited_fingerprint"), near(0).alias("near_edited"), near(1).alias("near_next"))


def _sketch_sql(name: str, column: str) -> str:
    """CTEs: name_k(doc_id, k), the distinct digests of d.column; name(doc_id, f), the written sketch."""
    blanks = "' ' || " + " || ".join(f"chr({ord(c)})" for c in BLANKS[1:])
    places = " UNION ALL ".join(f"SELECT doc_id, {t} AS t, (k >> {t * _BITS}) & {WIDTH - 1} AS i, k, x FROM {name}_x" for t in range(TABLES))
    return f"""{name}_k AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(line), 1, 16))::UBIGINT AS k FROM (SELECT doc_id, trim(unnest(string_split({column}, chr(10))), {blanks}) AS line FROM d) WHERE line <> ''),
{name}_x AS (SELECT doc_id, k, (a * a % {CHECK_P})::UBIGINT AS x FROM (SELECT doc_id, k, ((k >> 32) * {CHECK_A} + (k & 4294967295) * {CHECK_B} + {CHECK_C}) % {CHECK_P} AS a FROM {name}_k)),
{name}_c AS (SELECT doc_id, t, i, count(*) AS c, bit_xor(k) AS k, bit_xor(x) AS x FROM ({places}) GROUP BY doc_id, t, i),
{name} AS (SELECT d.doc_id, string_agg(format('{{:d}}:{{:016x}}:{{:08x}}', coalesce(c, 0), coalesce(k, 0::UBIGINT), coalesce(x, 0::UBIGINT)), ',' ORDER BY t, i) AS f
  FROM d CROSS JOIN (SELECT unnest(range({TABLES})) AS t) CROSS JOIN (SELECT unnest(range({WIDTH})) AS i) LEFT JOIN {name}_c USING (doc_id, t, i) GROUP BY d.doc_id)"""


def _near_sql(theirs: str) -> str:
    """The likeness of d's paragraphs to theirs(doc_id, k), by doc_id."""
    return f"""SELECT d.doc_id, CASE WHEN m.n IS NULL AND t.n IS NULL THEN 1.0 ELSE coalesce(b.n, 0)::DOUBLE / (coalesce(m.n, 0) + coalesce(t.n, 0) - coalesce(b.n, 0)) END AS near FROM d
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM own_k GROUP BY doc_id) m USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM {theirs} GROUP BY doc_id) t USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM own_k JOIN {theirs} USING (doc_id, k) GROUP BY doc_id) b USING (doc_id)"""


#: DuckDB SQL for fingerprints() over the table documents, for distinct ids that are not null.
FINGERPRINTS_SQL = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(doc_id) OVER w, max(doc_id) OVER ()) AS next_id, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after FROM base WINDOW w AS (ORDER BY doc_id DESC)),
d AS (SELECT *, length(text) AS n_chars, left(text, length(text) - length(text) // 2) || left(after, length(text) // 2) AS edited FROM o),
{_sketch_sql("own", "text")},
{_sketch_sql("new", "edited")},
next_k AS (SELECT d.doc_id, k FROM d JOIN own_k ON own_k.doc_id = d.next_id),
e AS ({_near_sql("new_k")}),
n AS ({_near_sql("next_k")})
SELECT d.doc_id, n_chars, sha256(edited) AS edited_sha256, own.f AS fingerprint, new.f AS edited_fingerprint, e.near AS near_edited, n.near AS near_next
FROM d JOIN own USING (doc_id) JOIN new USING (doc_id) JOIN e USING (doc_id) JOIN n USING (doc_id)
"""
