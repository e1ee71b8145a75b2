"""Secret scanning with an incremental blob ledger.

Every version of every text is content-addressed (SHA-256 of its bytes). The ledger is a table at a stable place in the shared
folder: one row for each (blob, rule_version) that was ever scanned, with its spans. A run looks up which of its blobs the ledger lacks
for the rules in force, scans those alone, each distinct one once, adds what it found as a folder of its own, and joins
findings back to all rows (paths and versions) that carry a blob. Rows of other rule versions stay as the history of what
was scanned. Runs may go on at the same time: a folder counts once its writer has marked it whole, and a blob that two runs
scanned is two equal rows, of which one is read.

Defined cases: a null text is an empty one and has no finding; repeated rows each get
their blob's findings; an empty table gives an empty result; other columns of the input are
not touched, whatever their names. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from quire.llm import common

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the longest run decides, so a run that is too short can't hide a match
_HEX = re.compile(r"[0-9a-f]{16,}")
#: What the scanner knows beyond the base kinds: a private key block from its header on (`_key_end` says how far), tokens with a fixed prefix, signed web tokens.
_MORE = (
    ("pem", re.compile(r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----")),
    ("prefixed", re.compile(r"\b(?:gh[opsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})")),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
)
#: What follows a key's header where its END line is missing: header fields, then lines of base64, the last maybe short. Line ends may be escaped.
_KEY_BODY = re.compile(
    r"(?:(?:\s|\\[nr])+[A-Za-z][A-Za-z-]*: [^\n\\]*)*(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{20,}={0,2})*(?:(?<=[A-Za-z0-9+/]{20})(?:\s|\\[nr])+(?:[A-Za-z0-9+/]+={1,2}|(?<=\n)[A-Za-z0-9+/]+(?=[ \t\r]*(?:\n|\Z))))?"
)
KINDS = ("assign", "access", "hex", *(k for k, _ in _MORE))
#: The rules in force: changes with any pattern, and its number with the code that applies them, so that blobs are scanned again.
RULE_VERSION = "4-" + hashlib.sha256("\n".join(p.pattern for p in (_ASSIGN, _ACCESS, _HEX, *(r for _, r in _MORE), _KEY_BODY)).encode()).hexdigest()[:12]
_SCAN = "blob binary, n_assign long, n_access long, n_hex long, base string, spans string"


def _key_end(text: str, header: re.Match) -> int:
    """Where the private key ends whose header this is: after its END line, if that comes before another block begins, else after its base64 lines."""
    end = f"-----END {header[1]}PRIVATE KEY-----"
    other = text.find("-----BEGIN ", header.end())
    at = text.find(end, header.end(), other if other >= 0 else len(text))
    return at + len(end) if at >= 0 else _KEY_BODY.match(text, header.end()).end()


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind in KINDS, end) of every finding, in that order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "-----BEGIN" in text or "_" in text or "xox" in text or "AIza" in text or "eyJ" in text:
        for k, (_, rule) in enumerate(_MORE, 3):
            found += [(m.start(), k, _key_end(text, m) if KINDS[k] == "pem" else m.end()) for m in rule.finditer(text)]
    found.sort()
    return found


def _render(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.sliced(batches):
        per = [find(x or "") for x in b.column("text").to_pylist()]
        n = [[sum(k == kind for _, k, _ in f) for f in per] for kind in range(3)]
        yield pa.record_batch(
            [
                b.column("blob").cast(pa.binary()), *(pa.array(x, pa.int64()) for x in n),
                pa.array([_render([x for x in f if x[1] < 3]) for f in per], pa.string()), pa.array([_render(f) for f in per], pa.string()),
            ],
            ["blob", "n_assign", "n_access", "n_hex", "base", "spans"],
        )


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


class Ledger:
    """All (blob, rule_version) pairs that were scanned, below one folder: rule_version=V/run=ID holds what one run added."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{common.shared_dir(spark)}/quire-secret-ledger"

    def _runs(self, pattern: str) -> list[str]:
        """Folders of runs that are whole, a path for each run."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}/run=*/_SUCCESS")
        found = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
        return sorted(x.getPath().getParent().toString() for x in found or [])

    def _read(self, runs: list[str]) -> DataFrame:
        schema = f"{_SCAN}, rule_version string"
        return self.spark.read.schema(schema).parquet(*runs) if runs else self.spark.createDataFrame([], schema)

    def known(self) -> DataFrame:
        """What the rules in force have scanned. A blob may come twice."""
        return self._read(self._runs(f"rule_version={RULE_VERSION}"))

    def history(self) -> DataFrame:
        """Every pair, each once."""
        return self._read(self._runs("rule_version=*")).dropDuplicates(["blob", "rule_version"])

    def add(self, scanned: DataFrame) -> DataFrame:
        """Writes one run's rows, and gives them back."""
        path = f"{self.path}/rule_version={RULE_VERSION}/run={uuid.uuid4().hex}"
        scanned.withColumn("rule_version", F.lit(RULE_VERSION)).write.parquet(path)
        return self._read([path])


def update(spark: SparkSession, docs: DataFrame, text: str = "text", ledger: Ledger | None = None) -> int:
    """Scans the blobs of docs that the ledger lacks and adds them; how many there were.

    Where the ledger knows some, only hashes are compared with it, and texts are looked at again only if their blob is unseen.
    Texts travel once for each distinct blob and map task.
    """
    ledger = ledger or Ledger(spark)
    known = ledger.known()
    blobs = docs.select(_blob(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not known.isEmpty():
        unseen = common.keep(spark, docs.select(_blob(text).alias("blob")).distinct().join(known, "blob", "left_anti"), "unseen")
        if unseen.isEmpty():
            return 0
        blobs = blobs.join(unseen, "blob", "left_semi")
    return ledger.add(blobs.groupBy("blob").agg(F.first("text").alias("text")).mapInArrow(_scan, _SCAN)).count()


def _hits(ledger: Ledger) -> DataFrame:
    """The ledger's rows with a finding, each blob once: few, and the only ones that meet the rows again."""
    return ledger.known().where(F.col("spans") != "").dropDuplicates(["blob"]).drop("rule_version")


def scan(spark: SparkSession, docs: DataFrame, key: str | Sequence[str] = "doc_id", text: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """key, blob, n_assign, n_access, n_hex, base, spans of every row of docs, after the ledger was brought up to date.

    key: the columns that tell paths and versions. A blob that a third of the rows share is one row on its side of the join and
    adaptive execution splits the other.
    """
    ledger, keys = ledger or Ledger(spark), [key] if isinstance(key, str) else list(key)
    update(spark, docs, text, ledger)
    rows = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), _blob(text).alias("blob")).join(_hits(ledger), "blob", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")]
    empty = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("base", "spans")]
    return rows.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "blob", *zero, *empty)


def redact(text: str, spans: str) -> str:
    """The text with each of the spans (kind:start:end, comma-joined) replaced by [SECRET]; overlapping ones become one."""
    out, at = [], 0
    for s, e in sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(","))):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(spark: SparkSession, docs: DataFrame, text: str = "text", length: str = "n_chars", ledger: Ledger | None = None) -> DataFrame:
    """docs with the ledger's findings cut out of its texts; the column of lengths, if there is one, follows."""
    ledger = ledger or Ledger(spark)
    update(spark, docs, text, ledger)
    hits = common.keep(spark, _hits(ledger).select("blob", "spans"), "hits")  # written, so that its bytes are known to the join
    rows = common.boxed(docs, blob=_blob(text))
    rows = rows.join(hits, "blob", "left").select(*(F.col("row")[c].alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col("spans").alias("spans"))
    at, n = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            spans, cols = b.column(b.num_columns - 1).to_pylist(), list(b.columns[:-1])
            if any(spans):
                now = [redact(x, s) if s else x for x, s in zip(cols[at].to_pylist(), spans, strict=True)]
                cols[at] = pa.array(now, pa.string())
                if n is not None:
                    cols[n] = pa.array([len(x) if s else c for c, x, s in zip(cols[n].to_pylist(), now, spans, strict=True)], cols[n].type)
            yield pa.record_batch(cols, [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, common.read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds alone, as text: what plain SQL can check of op5."""
    return scan(spark, common.read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.col("base").alias("base_spans"))


#: The base kinds in DuckDB's SQL: matches and what lies between them alternate, so running sums of both give the places.
SQL_BASE = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
kinds(kind, name, pattern) AS (VALUES
  (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+')
),
found AS (
  SELECT rid, kind, name, m[1] AS whole, m[2] AS value, list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN wholes[1:i - 1]]), 0) AS s
  FROM (
    SELECT rid, kind, name, gaps, wholes, unnest(range(1, len(wholes) + 1)) AS i, unnest(list_zip(wholes, values_)) AS m
    FROM (
      SELECT rid, kind, name, string_split_regex(text, pattern) AS gaps, regexp_extract_all(text, pattern, 0) AS wholes,
             CASE WHEN kind = 0 THEN regexp_extract_all(text, pattern, 2) ELSE regexp_extract_all(text, pattern, 0) END AS values_
      FROM docs, kinds WHERE regexp_matches(text, pattern)
    )
  )
),
kept AS (SELECT rid, kind, name, s::BIGINT AS s, (s + length(whole))::BIGINT AS e FROM found WHERE length(value) >= CASE kind WHEN 0 THEN 12 WHEN 1 THEN 18 ELSE 16 END),
told AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS base_spans
  FROM kept GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_spans, '') AS base_spans FROM docs LEFT JOIN told USING (rid)
"""
