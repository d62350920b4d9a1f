"""Quality rules from DataFrame functions only: base counts, and how often lines repeat across documents.

Line rule: lines are lower-cased, white space in them collapses, and a 64-bit hash stands for them. For each host (the source
column) and hash, the documents that hold it are counted, each once: a row is a document. With ``witness="texts"`` copies of one text count
once together; a pipeline that removes copies later asks for that, or a page would vanish because it was copied. Lines of any length counted above the limit are boilerplate and are taken out; a
document that has too small a part of its words left, or whose rest fails the base rule, is depleted and rejected.

Texts are split once: base counts and line hashes are stored beside the text, and the lines are counted and looked up from there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stored

SPACE = r"[\x20\x09-\x0D]+"
SIGNS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
WINDOW = 8
#: Base limits: least words, and most percent of the words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A line in more than LINE_DOCS documents of a host is boilerplate, however long it is.
#: A document is depleted if under LEAST_LEFT percent of its words are left.
LINE_DOCS, LEAST_LEFT = 20, 30
#: The boilerplate lines of hosts are broadcast as one list a host up to so many lines of a host and in all; beyond, they are joined by shuffles.
MOST_OF_HOST, MOST_LINES = 4096, 200_000


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def _without(text: Column, signs: str) -> Column:
    for c in signs:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more in the array. n log n for any text."""

    def covered(g: Column) -> Column:
        order = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(t: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(t, k)["h"] == F.get(t, j)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(twice, lambda k: F.get(t, k)["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda s, p: F.struct((s["n"] + F.least(F.lit(window), p - s["last"])).alias("n"), p.alias("last"))
        return _let(order, lambda t: F.aggregate(places(t), start, step, lambda s: s["n"]))

    def windows(h: Column) -> Column:
        g = F.transform(F.slice(h, F.lit(1), F.size(h) - window + 1), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, window)]))
        found = _let(g, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
        return F.when(F.size(h) < window, F.lit(0)).otherwise(found)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def base_counts(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text; null is empty."""
    text = F.coalesce(text, F.lit(""))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(_without(text, BLANKS)).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(f"[{SIGNS}]")).cast("long").alias("n_symbols"),
            _let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    return _let(words_of(text), counts)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def _norm(text: Column) -> Column:
    """Lower-cased, with runs of white space other than line ends as one space. Most texts hold single spaces only: they are not rewritten."""
    odd = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\x0b", "\f", "\r")])
    return F.lower(F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text))


def _hashed_lines(text: Column) -> Column:
    """array of struct(h: hash of the normalised line, w: its words) of the lines that are not blank; null for a null text."""
    lines = F.filter(F.transform(F.split(_norm(text), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")))


def _prepared(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The one pass over texts, stored: d0, d1, .. (the columns of docs in order), id, host, text_hash, c (base counts), lines."""
    frame = docs.toDF(*[f"d{k}" for k in range(len(docs.columns))])
    ident, text, host = (F.col(f"d{docs.columns.index(c)}") for c in (id_col, text_col, host_col))
    out = frame.select("*", ident.alias("id"), host.alias("host"), F.xxhash64(text).alias("text_hash"), base_counts(text).alias("c"))
    return stored(docs.sparkSession, out.select("*", _hashed_lines(text).alias("lines")), "lines")


def common_lines(rows: DataFrame, line_docs: int = LINE_DOCS, witness: str = "documents") -> DataFrame:
    """(c_host, c_h): the boilerplate lines of prepared rows. Counts are combined before their shuffle; texts, where they are the witnesses, before theirs."""
    if witness not in ("documents", "texts"):
        raise ValueError("documents or texts are counted")
    once = F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")
    held = rows.select("host", once) if witness == "documents" else rows.select("host", "text_hash", once).distinct()
    return held.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > line_docs).select(F.col("host").alias("c_host"), F.col("h").alias("c_h"))


def _with_common(rows: DataFrame, line_docs: int, witness: str) -> DataFrame:
    """Prepared rows with r_common: the distinct hashes of a row's boilerplate lines; null where it has none.

    Few boilerplate lines travel to the rows as a list for each host. Beyond the bounds the lines come to them by shuffles: a line that very many
    documents hold is one row on the counted side, and on the other its rows may be split by the adaptive skew join."""
    spark = rows.sparkSession
    common = stored(spark, common_lines(rows, line_docs, witness), "common")
    size = common.groupBy("c_host").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()  # one row
    if (size["most"] or 0) <= MOST_OF_HOST and (size["all"] or 0) <= MOST_LINES:
        lists = common.groupBy("c_host").agg(F.collect_list("c_h").alias("hashes"))
        joined = rows.join(F.broadcast(lists), F.col("host").eqNullSafe(F.col("c_host")), "left")
        found = F.array_intersect(F.transform("lines", lambda x: x["h"]), "hashes")
        return joined.select(*rows.columns, _let(found, lambda x: F.when(F.size(x) > 0, x)).alias("r_common"))
    lines = rows.select("id", "host", "text_hash", F.explode(F.transform("lines", lambda x: x["h"])).alias("h"))
    found = lines.join(common, F.col("host").eqNullSafe(F.col("c_host")) & (F.col("h") == F.col("c_h")))
    found = found.groupBy(F.col("id").alias("r_id"), F.col("host").alias("r_host"), F.col("text_hash").alias("r_hash")).agg(F.collect_set("h").alias("r_common"))
    same = F.col("id").eqNullSafe(F.col("r_id")) & F.col("host").eqNullSafe(F.col("r_host")) & (F.col("text_hash") == F.col("r_hash"))
    return rows.join(found, same, "left").select(*rows.columns, "r_common")


def _cleaned(text: Column) -> Column:
    stay = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains("r_common", F.xxhash64(F.trim(_norm(x)))))
    return F.when(F.col("r_common").isNull(), text).otherwise(F.concat_ws("\n", stay))


def _depleted(text: Column) -> Column:
    """Whether what is left of a text with boilerplate is too small a part of it, or fails the base rule by itself."""
    failed = lambda w: (100 * F.size(w) < LEAST_LEFT * F.col("c.n_words")) | base_failed(F.size(w), repeated_words(w))
    return F.when(F.col("r_common").isNull(), F.lit(False)).otherwise(_let(words_of(_cleaned(text)), failed))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, witness: str = "documents") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_common_words.

    Null and empty texts have no words and fail the base rule. Null hosts are one host of their own. Ids may be null or repeat: each row is judged
    for itself, and rows alike in id, host and text get the same verdict. Other columns are not read. An empty table gives an empty result.
    """
    rows = _with_common(_prepared(docs.select(id_col, text_col, host_col), id_col, text_col, host_col), line_docs, witness)
    words = F.aggregate(F.filter("lines", lambda x: F.array_contains("r_common", x["h"])), F.lit(0).cast("long"), lambda s, x: s + x["w"])
    counted = rows.select("id", "c.*", _depleted(F.col("d1")).alias("depleted"), F.when(F.col("r_common").isNull(), F.lit(0).cast("long")).otherwise(words).alias("n_common_words"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return counted.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.col("depleted")).alias("kept"), "n_common_words"
    )


def _out(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of docs again, with boilerplate lines taken out of the texts."""
    return rows.select(*[(_cleaned(F.col(f"d{k}")) if c == text_col else F.col(f"d{k}")).alias(c) for k, c in enumerate(docs.columns)])


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", witness: str = "documents") -> DataFrame:
    """The documents that the rules keep, with boilerplate lines taken out of the texts; other columns are unchanged, whatever their names. Each row is judged
    for itself, also where ids are null or repeat."""
    # lines are counted over all documents: those that fail the base rule hold them too
    rows = _with_common(_prepared(docs, id_col, text_col, host_col), LINE_DOCS, witness)
    sound = ~base_failed(F.col("c.n_words"), F.col("c.n_repeat_words"))
    return _out(rows.where(sound & ~_depleted(F.col(f"d{docs.columns.index(text_col)}"))), docs, text_col)


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, witness: str = "documents") -> DataFrame:
    """docs with boilerplate lines taken out of the texts; nothing else changes."""
    return _out(_with_common(_prepared(docs, id_col, text_col, host_col), line_docs, witness), docs, text_col)


def _covered_sql(name: str, words: str) -> str:
    """CTEs: name(doc_id, n) is how many of the words of table words(doc_id, w) lie in windows found twice or more."""
    return f"""{name}_win AS (SELECT doc_id, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM {words})),
{name}_dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM {name}_win) WHERE c > 1),
{name} AS (SELECT doc_id, sum(least({WINDOW}, i - p)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - {WINDOW}) AS p FROM {name}_dup) GROUP BY doc_id)"""


#: DuckDB SQL for judge() over the table documents.
JUDGE_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lf AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
{_covered_sql("cov", "d")},
ex AS (SELECT doc_id, source, text, pos, x, lower(regexp_replace(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, source, text, generate_subscripts(l, 1) AS pos, unnest(l) AS x FROM d JOIN lf USING (doc_id))),
common AS (SELECT source, line FROM ex GROUP BY source, line HAVING count(DISTINCT doc_id) > {LINE_DOCS}),
marked AS (SELECT ex.*, c.line IS NOT NULL AS cut FROM ex LEFT JOIN common c ON ex.source IS NOT DISTINCT FROM c.source AND ex.line = c.line),
rest AS (SELECT doc_id, sum(CASE WHEN cut THEN len(string_split(line, ' ')) ELSE 0 END) AS n, regexp_extract_all(coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (NOT cut), ''), '[^\x20\x09-\x0D]+') AS w
  FROM marked GROUP BY doc_id HAVING bool_or(cut)),
{_covered_sql("left_over", "rest")},
base AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words,
  length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lf.l) - len(list_distinct(lf.l)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(rest.n, 0)::BIGINT AS n_common_words,
  rest.n IS NOT NULL AND (100 * len(rest.w) < {LEAST_LEFT} * len(d.w) OR len(rest.w) < {LEAST_WORDS} OR 100 * coalesce(left_over.n, 0) > {MOST_REPEATED} * len(rest.w)) AS depleted
  FROM d JOIN lf USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN rest USING (doc_id) LEFT JOIN left_over USING (doc_id)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept, n_common_words FROM f
"""
