"""Host-level quality rules.

Each document is held against a few rules over its words, lines and symbols.  Failures are added up by host,
and the share of failing documents is shrunk towards what is usual: hosts are taken as draws from a beta
distribution whose two parameters come from the hosts themselves, by their mean and spread.  A host of few
documents so needs more than bad luck to be rejected.  The verdicts go back to the documents.

All of it is DataFrame operations.  What the rules measure is written once, a few numbers per document; the
texts are read in one pass and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.operators.skew import lookup_join
from boxmill.session import settle

# fixed values: the white space between words, and the characters that count as symbols
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
SYMBOL_PERCENT, LINE_PERCENT = 10, 30
# share of a host's documents that may fail each rule, after shrinking
LIMITS = {"base": 0.6, "symbols": 0.6, "lines": 0.6}
LEAST_SPREAD = 1e-4


def _repeated(words: Column) -> Column:
    """Words that stand in a window of ``WINDOW`` words that the text holds twice or more."""
    last = F.size(words) - (WINDOW - 1)
    codes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(held: Column) -> Column:
        # windows by code and place; equal ones are neighbours then
        pairs = F.sort_array(F.transform(held, lambda code, at: F.struct(code.alias("code"), at.alias("at"))))

        def of_sorted(rows: Column) -> Column:
            def same(at: Column) -> Column:
                here = F.get(rows, at)["code"]
                before = F.coalesce(F.get(rows, at - 1)["code"] == here, F.lit(False))
                return before | F.coalesce(F.get(rows, at + 1)["code"] == here, F.lit(False))

            places = F.array_compact(F.transform(rows, lambda r, n: F.when(same(n), r["at"])))
            # each window adds what lies beyond the end of the one before it
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = F.aggregate(
                F.sort_array(places),
                start,
                lambda s, at: F.struct(
                    (at + WINDOW).alias("end"), (s["n"] + at + WINDOW - F.greatest(s["end"], at)).alias("n")
                ),
            )
            return step["n"]

        return F.transform(F.array(pairs), of_sorted)[0]

    def counted(held: Column) -> Column:
        return F.when(F.size(F.array_distinct(held)) == F.size(held), F.lit(0)).otherwise(covered(held))

    return F.when(last < 2, F.lit(0)).otherwise(F.transform(F.array(codes), counted)[0])


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: the key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    Words are runs of characters that are no ASCII white space; a NULL text has none of anything.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.translate(body, BLANKS[1:], " " * 5), " ", -1), "")
    lines = F.filter(F.split(body, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)

    def all_of(held: Column) -> Column:
        return F.struct(
            F.size(held).cast("long").alias("n_words"),
            F.aggregate(held, F.lit(0), lambda s, w: s + F.length(w)).cast("long").alias("word_chars"),
            _repeated(held).cast("long").alias("n_repeat_words"),
        )

    def of_lines(held: Column) -> Column:
        return F.struct(F.size(held).alias("n"), F.size(F.array_distinct(held)).alias("distinct"))

    found = docs.select(
        F.col(key),
        F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("n")).alias("host"),
        F.transform(F.array(words), all_of)[0].alias("w"),
        F.transform(F.array(lines), of_lines)[0].alias("l"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return found.select(
        key, "host", "w.n_words", "w.word_chars", "n_symbols",
        (F.col("l.n") - F.col("l.distinct")).cast("long").alias("n_dup_lines"),
        "w.n_repeat_words", F.col("l.n").cast("long").alias("n_lines"),
    )


def _failures() -> dict[str, Column]:
    return {
        "base": (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words")),
        "symbols": F.lit(100) * F.col("n_symbols") > F.lit(SYMBOL_PERCENT) * F.col("n_words"),
        "lines": F.lit(100) * F.col("n_dup_lines") > F.lit(LINE_PERCENT) * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Per host: n documents, and ``rejected``; also the shrunk rate of each rule as ``rate_<rule>``.

    With mean m and variance v of the hosts' rates the prior is a beta distribution of weight m (1 - m) / v - 1
    (v is taken to be ``LEAST_SPREAD`` at least, the weight to be no less than 0), and a host of n documents
    with k failures gets (k + weight m) / (n + weight).  Each host counts once in m and v, however large.
    """
    limits = LIMITS if limits is None else limits
    counts = [F.sum(F.when(fails, 1).otherwise(0)).alias(f"k_{rule}") for rule, fails in _failures().items() if rule in limits]
    hosts = settle(measured.groupBy("host").agg(F.count("*").alias("n"), *counts))
    moments = []
    for rule in limits:
        rate = F.col(f"k_{rule}") / F.col("n")
        moments += [F.avg(rate).alias(f"m_{rule}"), F.var_pop(rate).alias(f"v_{rule}")]
    shrunk = _beside(hosts, hosts.agg(*moments))
    for rule in limits:
        m, v = F.col(f"m_{rule}"), F.greatest(F.col(f"v_{rule}"), F.lit(LEAST_SPREAD))
        weight = F.greatest(m * (1 - m) / v - 1, F.lit(0.0))
        shrunk = shrunk.withColumn(f"rate_{rule}", (F.col(f"k_{rule}") + weight * m) / (F.col("n") + weight))
    beyond = F.lit(False)
    for rule, limit in limits.items():
        beyond = beyond | (F.col(f"rate_{rule}") > F.lit(limit))
    return shrunk.select("host", "n", *[f"rate_{rule}" for rule in limits], beyond.alias("rejected"))


def _beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """The values of a one-row table as constants of every row."""
    values = one.first()
    return rows.select("*", *[F.lit(values[c]).cast("double").alias(c) for c in one.columns])


def judge(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    limits: dict[str, float] | None = None,
) -> DataFrame:
    """Per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Every row counts, also one that repeats another.  Rows of a NULL host are one host of their own.  A row is
    kept if it passes the base rules and its host is not rejected.
    """
    measured = settle(measure(docs, key, text, host))
    verdicts = host_verdicts(measured, limits).select("host", "n", "rejected")
    joined = lookup_join(measured, verdicts, ["host"], "left", weight="n")
    base = _failures()["base"]
    return joined.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~F.col("rejected")).alias("kept"),
    )


def judge_sql(docs: str) -> str:
    """The same rows in DuckDB SQL over the table or view ``docs``."""
    blank = "[ \\t\\n\\x0B\\x0C\\r]"
    moments, rates, beyond = [], [], []
    for rule, limit in LIMITS.items():
        moments.append(f"avg(k_{rule}::DOUBLE / n) AS m_{rule}, greatest(var_pop(k_{rule}::DOUBLE / n), {LEAST_SPREAD!r}::DOUBLE) AS v_{rule}")
        weight = f"greatest(m_{rule} * (1 - m_{rule}) / v_{rule} - 1, 0::DOUBLE)"
        rates.append(f"(k_{rule} + {weight} * m_{rule}) / (n + {weight}) AS rate_{rule}")
        beyond.append(f"rate_{rule} > {limit!r}::DOUBLE")
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce('h' || source, 'n') AS host, coalesce(text, '') AS text FROM {docs}),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '{blank}'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\x0C\\r]')) AS lines FROM base),
starts AS (SELECT r, pos, list_slice(words, pos, pos + {WINDOW - 1}) AS words
    FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS pos FROM split)),
twice AS (SELECT r, words FROM starts GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT s.r, unnest(range(s.pos, s.pos + {WINDOW})) AS place
    FROM starts s JOIN twice t ON t.r = s.r AND t.words = s.words) GROUP BY r),
measured AS (SELECT s.doc_id, s.host, len(s.words)::BIGINT AS n_words, length(array_to_string(s.words, ''))::BIGINT AS word_chars,
    (length(s.text) - length(translate(s.text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(s.lines) - len(list_distinct(s.lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(s.lines) AS n_lines FROM split s LEFT JOIN covered c USING (r)),
failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
    100 * n_symbols > {SYMBOL_PERCENT} * n_words AS symbols_failed, 100 * n_dup_lines > {LINE_PERCENT} * n_lines AS lines_failed
    FROM measured),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS k_base, count(*) FILTER (symbols_failed) AS k_symbols,
    count(*) FILTER (lines_failed) AS k_lines FROM failed GROUP BY host),
moments AS (SELECT {", ".join(moments)} FROM hosts),
shrunk AS (SELECT host, {", ".join(rates)} FROM hosts, moments),
verdicts AS (SELECT host, {" OR ".join(beyond)} AS rejected FROM shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT rejected AS kept FROM failed JOIN verdicts USING (host)"""
