"""Quality rules: a threshold table compiled into one projection, without user functions.

``THRESHOLDS`` names a measure, the words a text needs for the rule to apply, and the least and largest
allowed value.  ``measures`` computes every measure with built-in functions; ``quality_rules`` compiles the table to
one boolean expression and the list of rules that failed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in is that it for was on are as with he be at by this have from or "
    "der die das und ist nicht von mit den ein eine zu auf für im dem des sich als "
    "le la les de et est un une que pour dans qui pas sur au du des ou avec "
    "el los las en y que por una con para no se del al es lo como"
)


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    words: int = 0


#: The threshold table; ``words``: texts with fewer words are exempt.
THRESHOLDS = (
    Rule("word_length", "mean_word_chars", 1.5, 30.0),
    Rule("symbols", "symbol_ratio", None, 0.3),
    Rule("stop_words", "stop_ratio", 0.01, None, 80),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.6),
    Rule("bullets", "bullet_ratio", None, 0.9, 20),
    Rule("letters", "letter_word_ratio", 0.5, None),
)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for null, empty and blank texts."""
    trimmed = F.trim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1)).otherwise(F.array().cast("array<string>"))


def repeated_words(words: str, window: int = 5) -> Column:
    """Words inside windows whose content is in the text twice or more.

    Hashes of all windows tell texts without a repeated window; only for others are the windows' strings sorted,
    so that equal ones are neighbours.  The starts of repeated windows, in order, then cover
    ``min(window, gap to the next start)`` words each.
    """
    size = F.size(words)
    starts = F.sequence(F.lit(0), size - window)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(window))))
    pairs = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *(F.get(F.col(words), i + k) for k in range(window))).alias("w"), i.alias("i"))))

    def covered(rows: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda j: F.coalesce(F.get(rows, j - 1)["w"] == F.get(rows, j)["w"], F.lit(False)) | F.coalesce(F.get(rows, j + 1)["w"] == F.get(rows, j)["w"], F.lit(False)))
        ordered = F.array_sort(F.transform(at, lambda j: F.get(rows, j)["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("end"))
        step = lambda acc, i: F.struct((acc["n"] + F.lit(window) - F.greatest(acc["end"] - i, F.lit(0))).alias("n"), (i + window).alias("end"))
        return F.aggregate(ordered, start, step, lambda acc: acc["n"])

    exact = F.get(F.transform(F.array(pairs), covered), F.lit(0))
    many = F.size(F.array_distinct(hashes)) < size - (window - 1)
    return F.when(size <= window, F.lit(0).cast("long")).when(many, exact).otherwise(F.lit(0).cast("long"))


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the contract's counts and the ratios of the threshold table; ratios of nothing are 0."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(F.col(id_col), text.alias("_t")).withColumns({"_w": words_of(F.col("_t")), "_l": F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)})
    counted = base.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words("_w").alias("n_repeat_words"),
        F.size("_l").alias("_lines"),
        F.size(F.filter("_l", lambda x: x.rlike("^[\\x20\\x09-\\x0D]*[-*•]"))).alias("_bullets"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS.split())))).alias("_stops"),
        F.size(F.filter("_w", lambda x: x.rlike("\\p{L}"))).alias("_lettered"),
    )
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.withColumns({
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "stop_ratio": over("_stops", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "_lines"),
        "bullet_ratio": over("_bullets", "_lines"),
        "letter_word_ratio": over("_lettered", "n_words"),
    }).drop("_lines", "_bullets", "_stops", "_lettered")


def compiled(rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """Names of the failed rules."""
    failed = []
    for rule in rules:
        value = F.col(rule.measure)
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (value < rule.least)
        if rule.most is not None:
            bad = bad | (value > rule.most)
        failed.append(F.when(bad & (F.col("n_words") >= rule.words), F.lit(rule.name)))
    return F.array_compact(F.array(*failed))


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ratios, ``base_failed``, ``failed`` (names) and ``kept`` for each row.

    A null text counts as no words, which fails the base rules; so do fewer than 10 words and more than
    a fifth of repeated words.  Null ids and repeated rows are kept as they are.
    """
    out = measures(df, id_col, text_col)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumns({"base_failed": base, "failed": compiled(rules)}).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def rules_sql(rules: tuple[Rule, ...] = THRESHOLDS) -> str:
    """DuckDB SQL of the contract's columns and ``kept`` over the table ``documents``."""
    blank, stops = "[\\x20\\x09-\\x0D]", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS.split()))
    limits = []
    for r in rules:
        sides = [f"{r.measure} < {r.least}"] * (r.least is not None) + [f"{r.measure} > {r.most}"] * (r.most is not None)
        limits.append(f"(n_words >= {r.words} AND ({' OR '.join(sides)}))")
    over = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '{blank}+'), lambda x: x <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    word AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
    five AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS v
             FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
    n AS (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS times FROM five WHERE v IS NOT NULL),
    again AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM n WHERE times > 1) GROUP BY r),
    c AS (SELECT r, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{blank}', '', 'g'))::BIGINT AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                 len(ls) AS lines, len(list_filter(ls, lambda x: regexp_matches(x, '^{blank}*[-*•]'))) AS bullets,
                 len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS stops, len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) AS lettered FROM w),
    m AS (SELECT c.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, {over("word_chars", "n_words")} AS mean_word_chars,
                 {over("n_symbols", "n_words")} AS symbol_ratio, {over("stops", "n_words")} AS stop_ratio, {over("n_dup_lines", "lines")} AS dup_line_ratio,
                 {over("bullets", "lines")} AS bullet_ratio, {over("lettered", "n_words")} AS letter_word_ratio FROM c LEFT JOIN again USING (r)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT ({" OR ".join(limits)}) AS kept FROM b"""
