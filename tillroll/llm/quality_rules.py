"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at ``\\n``. The statistics of a text are array
expressions over its own words and lines, so nothing is shuffled. Five-word windows are compared by
64-bit hashes of their words' hashes within one text.

Defined results: a null or empty text has no words, so it fails the base rule; ratios over zero words
are 0; repeated rows are judged alike; an empty table gives no rows. The input's other columns are kept
only where named in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SYMBOLS = "#*$%&|<>"
_SPACE = "[\\x20\\x09-\\x0D]+"

# Frequent short words of four languages.
STOP_WORDS = (
    "the of and to in a is that for it with as was on be by this are from or an at not have "
    "de la le les et des en un une du que est pour dans qui par sur au pas avec "
    "der die das und zu den von mit sich auf für ist im dem nicht ein eine als auch es "
    "el los las del se por con para su al lo como y no una").split()


@dataclass(frozen=True)
class Rule:
    """``low <= ratio <= high`` must hold (None: no bound)."""
    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


# Production thresholds. The word counts and repetition of the base rule are judged before these.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.1),
    Rule("stop_word_ratio", "(n_stop_words + 1) / n_words", 0.02, None),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.4),
    Rule("letter_word_ratio", "n_letter_words / n_words", 0.5, None),
    Rule("stutter_ratio", "n_stutter / n_words", None, 0.3),
    Rule("longest_word", "longest_word", None, 200.0),
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def _repeated(grams: Column) -> Column:
    """Windows (hash, position) in the order of their hashes, only where a hash occurs twice."""
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams),
                  F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Base statistics of every text (whole texts)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(id_col, *keep, text.alias("_t"), words(F.col(text_col)).alias("_w"),
                    F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0).alias("_lines"))
    d = d.select(
        id_col, *keep, "_w", F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(F.translate(w, ".,;:!?()\"'", "")).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_w", lambda w: w.rlike("\\p{L}"))).cast("long").alias("n_letter_words"),
        F.coalesce(F.array_max(F.transform("_w", lambda w: F.length(w))), F.lit(0)).cast("long").alias("longest_word"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    d = d.withColumn("n_stutter", F.size(F.filter("_h", lambda h, i: h == F.get(F.col("_h"), i - 1))).cast("long"))
    grams = F.when(F.size("_h") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("_h") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)])))
    d = d.withColumn("_g", grams).drop("_w", "_h")
    d = d.withColumn("_s", _repeated(F.col("_g"))).drop("_g")
    twice = F.filter("_s", lambda e, k: (e["g"] == F.get(F.col("_s"), k - 1)["g"]) | (e["g"] == F.get(F.col("_s"), k + 1)["g"]))
    d = d.withColumn("_p", F.sort_array(F.transform(twice, lambda e: e["i"]))).drop("_s")
    steps = F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), k + 1) - p, F.lit(WINDOW))))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_p")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> tuple[list[Column], Column]:
    """One ratio column per rule and the condition that all hold."""
    ratios = [F.when(F.col("n_words") > 0, F.expr(r.ratio).cast("double")).otherwise(0.0).alias(r.name) for r in rules]
    holds = F.lit(True)
    for r in rules:
        if r.low is not None:
            holds = holds & (F.col(r.name) >= r.low)
        if r.high is not None:
            holds = holds & (F.col(r.name) <= r.high)
    return ratios, holds


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    ratios, holds = compile_rules(rules)
    d = statistics(docs, id_col, text_col, keep)
    known = set(d.columns)
    d = d.select("*", *[c for c, r in zip(ratios, rules) if r.name not in known])
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.withColumn("base_failed", base).withColumn("kept", ~base & holds)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT *, CASE WHEN len(ws) < 5 THEN [] ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i:i+4]) END AS gs FROM w),
p AS (SELECT doc_id, unnest(gs) AS gram, unnest(range(1, len(gs) + 1)) AS i FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM p),
k AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(5) AS s(j) WHERE c > 1 GROUP BY doc_id),
x AS (SELECT g.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words,
        len(list_filter(ws, lambda x: list_contains(string_split('STOP', ' '), lower(translate(x, '.,;:!?()"''', ''))))) AS n_stop_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
        len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter,
        coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS longest_word
      FROM g LEFT JOIN k ON g.doc_id = k.doc_id),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1 AND (n_stop_words + 1) / n_words >= 0.02
    AND n_dup_lines / n_lines <= 0.4 AND n_letter_words / n_words >= 0.5 AND n_stutter / n_words <= 0.3 AND longest_word <= 200 AS kept
FROM v""".replace("STOP", " ".join(STOP_WORDS))
