"""Operator 6, secret scans with corpus-wide ownership frequency.

Candidates are the matches of three fixed patterns and, beyond them, ``mixed`` strings of high entropy and ``bare``
strings (token-like, with a letter and a digit). Each candidate's value is hashed, and its hash is counted over the whole
corpus by distinct owners (``source``) and distinct repositories (``doc_id``): what more than ``LIVE_OWNERS`` owners or
more than ``LIVE_REPOSITORIES`` repositories carry is a widely copied example, what fewer do looks live. Matches of the
fixed patterns are always reported, with that verdict; of the others, mixed strings are added where they look live, and
bare strings where they also are the value of a fixed pattern's match anywhere in the corpus: a credential that one
document names as such is found in others that only quote it.

Owners and repositories are made distinct under ``(value, owner)`` and ``(value, repository)`` before they are counted
under ``value``, all with partial sums, so an example in a third of all documents is a row per task; verdicts go back to
the candidates by a join in which values of many candidates are salted.

Cases: a null text is empty; a null owner is an owner of its own, a null id a repository of its own; repeated rows are
one repository; an empty table gives no rows; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY_LEAST, byte_texts, fresh, heavy_keys, keyed_rows, materialize, read_documents, row_key, salted_join

KINDS = ("assign", "access", "hex", "mixed", "bare")
MIXED_KIND, BARE_KIND = 3, 4
#: A value of more owners, or of more repositories, than this is an example.
LIVE_OWNERS, LIVE_REPOSITORIES = 2, 16
#: Bits a character that a mixed string must have.
MIXED_ENTROPY = 3.5
MIXED_LEAST = 20
#: Least length of a bare string.
BARE_LEAST = 12

# The patterns of the contract.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

MIXED = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIXED_LEAST},}}")
BARE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{BARE_LEAST},}}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _members(alphabet: bytes) -> bytes:
    return bytes(1 if c in alphabet else 0 for c in range(256))


_DIGITS, _SMALL = b"0123456789", b"abcdefghijklmnopqrstuvwxyz"
_HEX_SET, _BARE_SET = _members(_DIGITS + b"abcdef"), _members(_DIGITS + _SMALL + _SMALL.upper() + b"+/_.=-")


def _is_mixed(value: str) -> bool:
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= MIXED_ENTROPY


def find_base(data: bytes, text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of the contract's matches. Cheap searches on the bytes rule most texts out first."""
    found = []
    low = data.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if b"\x01" * HEX_LEAST in data.translate(_HEX_SET):
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return sorted(found)


def _apart(found: list[tuple[int, int, int, str]], taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Those of ``found`` that overlap nothing in ``taken`` (in order of start)."""
    starts, ends = [], []
    for start, _, stop, _ in taken:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], stop)
        else:
            starts.append(start)
            ends.append(stop)
    out = []
    for x in found:
        k = bisect_right(ends, x[0])  # the first span that ends after the candidate's start
        if k == len(starts) or starts[k] >= x[2]:
            out.append(x)
    return out


def find_others(data: bytes, text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Mixed strings that touch no match of the fixed patterns, and bare ones that touch neither."""
    if b"\x01" * BARE_LEAST not in data.translate(_BARE_SET):
        return []
    mixed = _apart([(m.start(), MIXED_KIND, m.end(), m[0]) for m in MIXED.finditer(text) if _is_mixed(m[0])], base)
    bare = []
    for m in BARE.finditer(text):
        value = m[0].strip(".=-")
        if len(value) >= BARE_LEAST and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            start = m.start() + m[0].index(value)
            bare.append((start, BARE_KIND, start + len(value), value))
    return mixed + _apart(bare, sorted(base + mixed))


def _value(value: str) -> str:
    return xxhash.xxh3_128_hexdigest(value)


CANDIDATES = (
    "k_id bigint, k_text bigint, doc_id bigint, owner string, row bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
    "candidates array<struct<start:bigint,kind:int,stop:bigint,value:string>>"
)


def find_candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """A row per document with its counts, the digest of its base matches, and all candidates by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("value", pa.string())])
        for batch in batches:
            counts, digests, candidates = ([], [], []), [], []
            for data in byte_texts(batch.column(5)):
                text = data.decode("utf-8")
                base = find_base(data, text)
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
                every = sorted(base + find_others(data, text, base))
                candidates.append([{"start": s, "kind": k, "stop": e, "value": _value(v)} for s, k, e, v in every])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(candidates, pa.list_(struct))],
                names=["k_id", "k_text", "doc_id", "owner", "row", "n_assign", "n_access", "n_hex", "base_sha256", "candidates"],
            )

    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, CANDIDATES)


def ownership(candidates: DataFrame) -> DataFrame:
    """``(value, owners, repositories, named, n)`` over all candidates: distinct owners and repositories of a value,
    whether a fixed pattern matched it anywhere, and the number of its candidates."""
    each = candidates.select("k_id", "owner", F.explode("candidates").alias("c")).select("k_id", "owner", F.col("c.value").alias("value"), (F.col("c.kind") < MIXED_KIND).alias("base"))
    owned = each.groupBy("value", "owner").agg(F.max("base").alias("base"), F.count(F.lit(1)).alias("n"))
    owners = owned.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.max("base").alias("named"), F.sum("n").alias("n"))
    repositories = each.groupBy("value", "k_id").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.join(repositories, "value").select("value", "owners", "repositories", "named", "n")


FOUND = "array<struct<start:bigint,kind:int,stop:bigint,owners:bigint,repositories:bigint,live:boolean>>"


def scan_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES,
    heavy_least: int = HEAVY_LEAST,
) -> DataFrame:
    """Per document: key columns, counts, digest and ``found`` (:data:`FOUND`), the base spans and the added ones."""
    rows = materialize(find_candidates(docs, id_col=id_col, text_col=text_col, owner_col=owner_col), "secrets")
    seen = materialize(ownership(rows), "secret-owners")
    heavy = materialize(heavy_keys(seen.select("value", "n"), seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], heavy_least), "secret-heavy")
    live = (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)
    each = rows.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    each = salted_join(each, seen.select("value", "owners", "repositories", "named", live.alias("live")), ["value"], heavy)
    each = each.where((F.col("kind") < MIXED_KIND) | F.col("live") & ((F.col("kind") == MIXED_KIND) | F.col("named")))
    found = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "owners", "repositories", "live"))).alias("found"))
    return rows.drop("candidates", "owner").join(found, "row", "left").drop("row").withColumn("found", F.coalesce("found", F.expr(f"cast(array() as {FOUND})")))


def span_text(found: str = "found", verdict: bool = False) -> F.Column:
    """Spans as ``kind:start:end``, comma-joined; with their owners, repositories and verdict if asked for."""
    names = F.array(*[F.lit(k) for k in KINDS])
    place = lambda x: [F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string")]
    more = lambda x: [x["owners"].cast("string"), x["repositories"].cast("string"), F.when(x["live"], "live").otherwise("example")]
    return F.concat_ws(",", F.transform(F.col(found), lambda x: F.concat_ws(":", *place(x), *(more(x) if verdict else []))))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[SECRET]", **limits: int) -> DataFrame:
    """``docs`` with every span that looks live replaced by ``mark``; widely copied examples stay.

    Documents without such spans pass unchanged; the join is hashed on the side of the spans, of rows that are alike one.
    """
    found = scan_secrets(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, **limits)
    spans = found.select("k_id", "k_text", F.filter("found", lambda x: x["live"]).alias("found")).where("size(found) > 0")
    spans = spans.groupBy("k_id", "k_text").agg(F.first("found").alias("found"))  # rows alike have the same spans
    keyed, (k_id, k_text) = keyed_rows(docs, id_col, text_col)
    starts, stops = fresh(keyed.columns, "starts"), fresh(keyed.columns, "stops")
    spans = spans.select(F.col("k_id").alias(k_id), F.col("k_text").alias(k_text), F.col("found.start").alias(starts), F.col("found.stop").alias(stops))
    joined = keyed.join(spans.hint("shuffle_hash"), [k_id, k_text], "left").select(*docs.columns, starts, stops)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, starts, stops in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if starts:
                    out, at = [], 0
                    for lo, hi in sorted(zip(starts, stops)):
                        if lo >= at:
                            out += [text[at:lo], mark]
                        at = max(at, hi)
                    text = "".join([*out, text[at:]])
                texts.append(text)
            columns = batch.columns[:-2]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2])

    return joined.mapInArrow(run, docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_documents(spark, sf_dir))
    of = lambda live: F.size(F.filter("found", lambda x: x["live"] == live)).cast("long")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", span_text().alias("spans"), span_text(verdict=True).alias("verdicts"), of(True).alias("n_live"), of(False).alias("n_examples"))
