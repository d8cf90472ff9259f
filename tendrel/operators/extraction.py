"""Model calls as a stage of a plan: providers, bounded retries, and a strict parser of their replies.

A provider is anything with `complete(prompt) -> str`; it is built once per task from a factory, so that clients need not
be sent to the executors. Calls go out row by row within a task; the number of tasks is the number of calls at once.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CANDIDATES, MAX_EVIDENCE, MAX_VALUE, MAX_REASON = 200, 3, 600, 200


class TransientError(Exception):
    """A failure that may pass: it is tried again."""


class ConfigError(Exception):
    """A failure that no second try mends."""


class Provider(Protocol):
    def complete(self, prompt: str) -> str:
        """The model's reply."""


class EmbeddingClient(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        """A vector for every text."""


def embed_missing(texts: DataFrame, cache: DataFrame, factory: Callable[[], EmbeddingClient], model: str, batch: int = 100) -> DataFrame:
    """cache_key and vector of every different text (column text) that the cache (column cache_key) lacks.

    The key is the SHA-256 of `model:text`. Null and empty texts have none. Clients get up to `batch` texts at once; the
    result is to be appended to the cache table by the caller.
    """
    keyed = texts.where("text <> ''").select(F.sha2(F.concat(F.lit(f"{model}:"), "text"), 256).alias("cache_key"), "text")
    missing = keyed.dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")
    schema = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client: EmbeddingClient | None = None
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                client = client or factory()
                vectors = client.embed_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], schema.names)

    return missing.mapInArrow(run, schema)


class ScriptedProvider:
    """Replays replies, raises exceptions, or calls functions of the prompt, in order; for tests."""

    def __init__(self, script: list, default: str | None = None):
        self.script, self.default, self.prompts = list(script), default, []

    def complete(self, prompt: str) -> str:
        self.prompts.append(prompt)
        step = self.script.pop(0) if self.script else self.default
        if step is None:
            raise TransientError("the script is at its end")
        if isinstance(step, Exception):
            raise step
        return step(prompt) if callable(step) else step


def provider_factory(settings: Mapping[str, str], known: Mapping[str, Callable[[], Provider]], default: str | None = None) -> Callable[[], Provider]:
    """The factory that the setting LLM_PROVIDER names among the known ones; ConfigError for a name that is not there."""
    name = (settings.get("LLM_PROVIDER") or default or "").strip().lower()
    if name not in known:
        raise ConfigError(f"LLM_PROVIDER is {name!r}; known are {sorted(known)}")
    return known[name]


def complete_with_retries(provider: Provider, prompt: str, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    """The reply, with up to `retries` more tries after 1, 2, 4 ... seconds for transient errors only."""
    for attempt in range(retries + 1):
        try:
            return provider.complete(prompt)
        except TransientError:
            if attempt == retries:
                raise
            sleep(2.0**attempt)
    raise AssertionError("unreachable")


def reply_schema(fields: list[str], handles: list[str]) -> dict:
    """The JSON schema that `parse_reply` accepts, with the names of this package only."""
    name = {"type": "string", "enum": list(fields)}
    text = {"type": "string", "minLength": 1, "maxLength": MAX_VALUE}
    piece = {
        "type": "object",
        "additionalProperties": False,
        "required": ["evidence_id", "quote"],
        "properties": {"evidence_id": {"type": "string", "enum": list(handles)}, "quote": text},
    }
    candidate = {
        "type": "object",
        "required": ["field", "value", "evidence"],
        "properties": {"field": name, "value": text, "evidence": {"type": "array", "minItems": 1, "items": piece}},
    }
    missing = {"type": "object", "required": ["field"], "properties": {"field": name, "reason": {"type": "string"}}}
    return {
        "type": "object",
        "additionalProperties": False,
        "required": ["candidates", "not_found"],
        "properties": {
            "candidates": {"type": "array", "maxItems": MAX_CANDIDATES, "items": candidate},
            "not_found": {"type": "array", "items": missing},
        },
    }


def prompt_hash(version: str, prompt: str, schema: dict) -> str:
    """A hash of all that decides a reply, whatever the order of the schema's keys."""
    text = json.dumps({"version": version, "prompt": prompt, "schema": schema}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def candidate_id(field: str, chunk_ids: list[str], value: object) -> str:
    """The id of a candidate: equal for equal field, chunks in any order, and value."""
    text = f"{field}:{'_'.join(sorted(chunk_ids))}:{json.dumps(value, sort_keys=True)}"
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def parse_reply(text: str, fields: list[str], handles: list[str]) -> list[tuple[str, str | None, str | None, str | None, str | None]]:
    """(kind, field, value, handle, detail) of a reply; kinds: candidate, not_found, rejected, warning, missing, error.

    The envelope is an object with exactly `candidates` and `not_found`. Candidates need a known field, a value of 1 to
    600 characters and at least one known handle with a quote; repeats are dropped with a warning, and evidence beyond
    three pieces is cut. Fields that come in neither list are missing.
    """
    try:
        reply = json.loads(text)
    except ValueError as e:
        return [("error", None, None, None, f"invalid_json: {e}"[:500])]
    if not isinstance(reply, dict) or set(reply) != {"candidates", "not_found"} or not all(isinstance(reply[k], list) for k in reply):
        return [("error", None, None, None, "schema: an object with the lists candidates and not_found is expected")]
    out: list[tuple] = []
    seen: set = set()
    covered: set = set()
    for item in reply["candidates"][:MAX_CANDIDATES]:
        name = item.get("field") if isinstance(item, dict) else None
        if name not in fields:
            out.append(("rejected", str(name)[:100], None, None, "unknown_field"))
            continue
        value, evidence = item.get("value"), item.get("evidence")
        if not isinstance(evidence, list) or not evidence:
            out.append(("rejected", name, None, None, "no_evidence"))
            continue
        if not isinstance(value, str) or not value.strip() or len(value) > MAX_VALUE:
            out.append(("rejected", name, None, None, "format_error"))
            continue
        pieces = list(dict.fromkeys((e.get("evidence_id"), e.get("quote")) for e in evidence if isinstance(e, dict)))
        if len(pieces) < len(evidence):
            out.append(("warning", name, value, None, "duplicate_evidence"))
        if any(h not in handles for h, _ in pieces):
            out.append(("rejected", name, value, None, "unknown_evidence_id"))
            continue
        if any(not isinstance(q, str) or not q.strip() or len(q) > MAX_VALUE for _, q in pieces):
            out.append(("rejected", name, value, None, "invalid_quote"))
            continue
        key = (name, value, frozenset(h for h, _ in pieces))
        if key in seen:
            out.append(("warning", name, value, None, "duplicate_candidate"))
            continue
        seen.add(key)
        covered.add(name)
        out += [("candidate", name, value, h, q) for h, q in pieces[:MAX_EVIDENCE]]
    if len(reply["candidates"]) > MAX_CANDIDATES:
        out.append(("warning", None, None, None, "too_many_candidates"))
    for item in reply["not_found"]:
        name = item.get("field") if isinstance(item, dict) else None
        if name not in fields:
            out.append(("warning", str(name)[:100], None, None, "unknown_field"))
            continue
        covered.add(name)
        out.append(("not_found", name, None, None, str(item.get("reason", ""))[:MAX_REASON]))
    return out + [("missing", name, None, None, None) for name in fields if name not in covered]


def extract(
    packages: DataFrame,
    factory: Callable[[], Provider],
    corrections: int = 1,
    retries: int = 3,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """package_id, status, kind, field, value, handle, detail: what the model says to every package.

    packages: package_id, prompt, fields (array) and handles (array). An invalid reply is sent back with its error up to
    `corrections` times. Status: ok, invalid_output, provider_error; a package that fails has one row of kind error. A null
    prompt is an error as well. Rows are spread over the session's shuffle partitions, as a call costs far more than a row.
    """
    schema = T.StructType(
        [
            packages.schema["package_id"],
            *(T.StructField(n, T.StringType()) for n in ("status", "kind", "field", "value", "handle", "detail")),
        ]
    )

    def answered(provider: Provider, prompt: str, fields: list[str], handles: list[str]) -> list[tuple]:
        asked = prompt
        for attempt in range(corrections + 1):
            rows = parse_reply(complete_with_retries(provider, asked, retries, sleep), fields, handles)
            if rows[:1] and rows[0][0] == "error":
                if attempt == corrections:
                    return [("invalid_output", *rows[0])]
                asked = f"{prompt}\n\nThe last reply was invalid: {rows[0][4]}\nReply with the JSON object only."
                continue
            return [("ok", *r) for r in rows]
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider: Provider | None = None
        for batch in batches:
            for k, (prompt, fields, handles) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                try:
                    if prompt is None:
                        raise ConfigError("the prompt is null")
                    provider = provider or factory()
                    rows = answered(provider, prompt, fields or [], handles or [])
                except (TransientError, ConfigError) as e:
                    rows = [("provider_error", "error", None, None, None, f"{type(e).__name__}: {e}"[:500])]
                if rows:
                    at = pa.array([k] * len(rows))
                    columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *columns], schema.names)

    tasks = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packages.select("package_id", "prompt", "fields", "handles").repartition(tasks).mapInArrow(run, schema)


def group_status(results: DataFrame) -> DataFrame:
    """status and packages: how many packages ended how."""
    return results.select("package_id", "status").distinct().groupBy("status").agg(F.count("*").alias("packages"))


def coverage(results: DataFrame) -> DataFrame:
    """package_id, field and state of every field that a reply was asked for: candidates, not_found, both or missing.

    results: what `extract` gives; packages without a valid reply have no rows.
    """
    told = results.where(F.col("kind").isin("candidate", "not_found", "missing") & F.col("field").isNotNull())
    has = [F.bool_or(F.col("kind") == k).alias(k) for k in ("candidate", "not_found")]
    flags = told.groupBy("package_id", "field").agg(*has)
    state = F.when(F.col("candidate") & F.col("not_found"), "both").when(F.col("candidate"), "candidates").when(F.col("not_found"), "not_found")
    return flags.select("package_id", "field", state.otherwise("missing").alias("state"))


def resolved(results: DataFrame, handles: DataFrame) -> DataFrame:
    """results with the chunk_id of every handle; null where a row has none or its package does not know it.

    handles: package_id, handle, chunk_id, doc_label (D1, D2 ...) and excerpt (its place in the package), a row per handle.
    """
    return results.join(handles.select("package_id", "handle", "chunk_id"), ["package_id", "handle"], "left")


def in_order(results: DataFrame, handles: DataFrame, names: list[str]) -> DataFrame:
    """package_id, place (from 1), field, value, handle and detail of the candidates of every package, in a fixed order.

    By the field's place in `names`, the number of the document, the first excerpt that the candidate draws on, the value,
    the handle. Replies are bounded (MAX_CANDIDATES), so a window holds the rows of one.
    """
    rows = results.where("kind = 'candidate'").join(handles.select("package_id", "handle", "doc_label", "excerpt"), ["package_id", "handle"], "left")
    number = F.coalesce(F.regexp_extract("doc_label", r"^.(\d+)$", 1).try_cast("int"), F.lit(0))
    of = Window.partitionBy("package_id", "field", "value")
    rows = rows.withColumns({"_field": F.array_position(F.array(*map(F.lit, names)), F.col("field")), "_doc": F.min(number).over(of), "_first": F.min("excerpt").over(of)})
    order = Window.partitionBy("package_id").orderBy("_field", "_doc", "_first", "value", "excerpt", "handle", "detail")
    return rows.select("package_id", F.row_number().over(order).alias("place"), "field", "value", "handle", "detail")
