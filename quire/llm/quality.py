"""Quality rules with verdicts on hosts.

Each document is measured once and tested against document rules. The failures are summed by host
(the column `source`), each host's failure rate is drawn towards the corpus rate by a beta prior that
is fitted to all hosts by the method of moments, and the verdict on the host is joined back. A document is
kept if it doesn't fail the base rules and its host isn't refused. The rule on symbols speaks of hosts only: a document that breaks it
alone is kept, unless its host's rate is too high.

Defined cases: a null text has no words and fails; a null host is a host of its own; a repeated row
counts and is judged each time; with no row there is no host and no result; a key may be null.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import common

_WORD, _BLANK = re.compile(r"[^\x20\x09-\x0D]+"), " \t\n\x0b\x0c\r"
#: What str.split() takes for white space beyond the rule's six characters.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_pct: int = 50
    #: Symbols for each hundred words; prose stays far below, mark-up residue and tables are above.
    max_symbol_pct: int = 10
    #: A host is refused if its shrunken failure rate reaches this: more of what it has is junk than not.
    max_host_rate: float = 0.5
    #: Bounds of the fitted prior's weight, in documents; hosts that hardly differ would make it infinite.
    prior_weight: tuple[float, float] = (1.0, 1e6)


def measure(text: str) -> tuple[int, int, int, int, int]:
    words = _WORD.findall(text) if _ODD.search(text) else text.split()
    symbols = sum(map(text.count, "#*$%&|<>"))
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.strip(_BLANK)]
        dup = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, until = Counter(windows), 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return len(words), sum(map(len, words)), symbols, dup, repeated


def measured(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """key, host and the five counts of every row."""
    kind = docs.schema[key].dataType.simpleString(), docs.schema[host].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            got = list(zip(*[measure(x or "") for x in b.column(2).to_pylist()], strict=True)) or [[]] * 5
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in got)], ["key", "host", *_COUNTS])

    return docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text")).mapInArrow(run, f"key {kind[0]}, host {kind[1]}, " + ", ".join(f"{c} long" for c in _COUNTS))


def failures(rules: Rules) -> dict[str, F.Column]:
    few = F.col("n_words") < rules.min_words
    repeats = 100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words")
    return {"base_failed": few | repeats, "symbols_failed": 100 * F.col("n_symbols") > rules.max_symbol_pct * F.col("n_words")}


def host_rates(judged: DataFrame, rules: Rules) -> DataFrame:
    """host, n, failed, rate (shrunken), refused. Sums are made before the shuffle, so a hot host is a row a task."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("base_failed") | F.col("symbols_failed")).cast("long")).alias("failed"))
    share = F.col("failed") / F.col("n")
    got = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("k"), F.avg(share).alias("mean"), F.var_pop(share).alias("var"), F.avg(1 / F.col("n")).alias("noise")).first()
    mean, (low, high) = (got["failed"] / got["n"] if got["n"] else 0.5), rules.prior_weight
    spread = mean * (1 - mean)
    between = max((got["var"] or 0.0) - spread * (got["noise"] or 0.0), 0.0)  # what sampling alone doesn't explain
    weight = min(max(spread / between - 1, low), high) if between > 0 else high
    rate = (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate >= rules.max_host_rate).alias("refused"))


def judge(spark: SparkSession, docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, host, the counts, base_failed, symbols_failed, host_refused, kept of every row."""
    rows = common.keep(spark, measured(docs, key, text, host), "measured").select("*", *(c.alias(n) for n, c in failures(rules).items()))
    refused = host_rates(rows, rules).where("refused").select(F.col("host").alias("bad_host"), F.lit(True).alias("host_refused"))
    out = rows.join(refused, rows["host"].eqNullSafe(refused["bad_host"]), "left").drop("bad_host")
    out = out.withColumn("host_refused", F.coalesce("host_refused", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_refused")).withColumnRenamed("key", key)


def passing(spark: SparkSession, docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that are kept, with their columns.

    Rules are tested where the row is, once for the hosts' sums and once to filter: measuring again costs less than keeping all rows beside their verdicts.
    Only sums by host are shuffled.
    """
    tested = measured(docs, key, text, host).select("host", *(c.alias(n) for n, c in failures(rules).items()))
    rates = common.keep(spark, host_rates(common.keep(spark, tested, "tested"), rules), "hosts")
    i = docs.columns.index(text)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # any name goes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            good = []
            for x in b.column(i).to_pylist():
                words, _, _, _, repeated = measure(x or "")
                good.append(words >= rules.min_words and 100 * repeated <= rules.max_repeat_pct * words)
            yield b.filter(pa.array(good, pa.bool_()))

    return common.but(spark, plain.mapInArrow(run, plain.schema).toDF(*docs.columns), host, rates.where("refused").select("host"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, common.read(spark, sf_dir, "documents")).select("doc_id", *_COUNTS, "base_failed", "kept")


#: The whole query in DuckDB's SQL, by the same definitions.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM docs
),
windows AS (
  SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM parts WHERE len(words) > 2)
),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows),
repeated AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM again WHERE n > 1) GROUP BY rid),
measured AS (
  SELECT rid, doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN words]), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM parts LEFT JOIN repeated USING (rid)
),
failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * n_words AS symbols_failed FROM measured
),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR symbols_failed) AS bad FROM failed GROUP BY source),
moments AS (SELECT sum(bad) / sum(n) AS mean, var_pop(bad / n) - sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) * avg(1 / n) AS spread FROM hosts),
prior AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM moments),
refused AS (SELECT source, (bad + mean * weight) / (n + weight) >= 0.5 AS refused FROM hosts, prior)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT r.refused AS kept
FROM failed f JOIN refused r ON f.source IS NOT DISTINCT FROM r.source
"""
