"""Writing documents, grading results, the declared party and cached replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.text import cache_key
from skeinwork.operators.grade import score_block

VERSION = "1.0"


def restricted_path(path: str) -> str:
    """The place of a document's public part: the stem with ``_restricted``, the suffix kept."""
    folder, slash, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    return f"{folder}{slash}{f'{stem}_restricted{dot}{suffix}' if stem else f'{name}_restricted'}"


def write_document(document: DataFrame, path: str, column: str = "document") -> None:
    """The text below ``path``, ended by a line end (a null one is none, an empty one an empty line)."""
    document.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_documents(full: DataFrame, restricted: DataFrame | None, path: str, column: str = "document") -> list[str]:
    """The full document, and the public one beside it if it was asked for, even if nothing in it is public."""
    write_document(full, path, column)
    if restricted is None:
        return [path]
    write_document(restricted, restricted_path(path), column)
    return [path, restricted_path(path)]


def _json(c: Column) -> Column:
    """A value in JSON; null for null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def json_object(fields: dict[str, Column], always: tuple[str, ...] = ()) -> Column:
    """A JSON object of values that are JSON already; a null field is left out, those of ``always`` are written as null."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)).otherwise(F.lit(f'"{k}":null' if k in always else None)) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ","), F.lit("}"))


def _score(prefix: str) -> dict[str, Column]:
    n = {k: _json(F.col(f"{prefix}n_{k}")) for k in ("pass", "partial", "fail", "na")}
    return n | {"applicable": _json(F.col(f"{prefix}applicable")), "score": F.when(F.col(f"{prefix}score").isNotNull(), _json(F.col(f"{prefix}score"))), "score_display": _json(F.col(f"{prefix}display"))}


def _items(items: DataFrame) -> DataFrame:
    """One array of items per document, in the order of ``ord``."""
    evidence = json_object({"lines": _json(F.coalesce("lines", F.expr("array()").cast("array<int>"))), "detail": _json(F.col("detail")), "expected": _json(F.col("expected")), "found": _json(F.col("found"))})
    one = json_object({"id": _json(F.col("id")), "description": _json(F.col("description")), "engine": _json(F.col("engine")), "status": _json(F.col("status")), "evidence": evidence})
    return items.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("__items"))


def _display(credit: Column, applicable: Column) -> Column:
    whole = credit == F.floor(credit)
    return F.concat(F.when(whole, F.floor(credit).cast("string")).otherwise(credit.cast("string")), F.lit("/"), applicable.cast("string"))


def result_json(items: DataFrame, kind: str, graded_at: Column, mechanical: tuple[str, str] | None = None, model: Column | None = None, buckets: dict[str, Column] | None = None, partial_weight: float = 0.0) -> DataFrame:
    """``doc_id``, ``json``: one grading result per document.

    ``items``: ``doc_id``, ``ord``, ``id``, ``description``, ``engine``, ``status``, ``lines``, ``detail``, ``expected``, ``found``. Without
    ``buckets`` (name to condition) there is one summary, else one score for each. A missing score is written as null,
    other missing fields are left out. The ``model`` is among the graders if one of its items was judged, or always where
    no ``mechanical`` one is.
    """
    whole = score_block(items, ["doc_id"], "status").withColumn("display", _display(F.col("n_pass").cast("double"), F.col("applicable")))
    ran = items.groupBy("doc_id").agg(F.max((F.col("engine") == "model") & (F.col("status") != "skipped")).alias("__ran"))
    out = whole.join(ran, "doc_id").join(_items(items), "doc_id")
    if buckets is None:
        fields = _score("")
        summary = json_object({**{k: fields[k] for k in ("pass", "partial", "fail", "na")}, "skipped": _json(F.col("n_skipped")), **{k: fields[k] for k in ("applicable", "score", "score_display")}, "complete": _json(F.col("complete"))}, ("score",))
    else:
        parts = {}
        for name, mine in buckets.items():
            one = score_block(items.withColumn("status", F.when(mine, F.col("status"))), ["doc_id"], "status", partial_weight)
            one = one.withColumn("display", _display(F.col("n_pass") + partial_weight * F.col("n_partial"), F.col("applicable")))
            out = out.join(one.select("doc_id", *[F.col(c).alias(f"{name}__{c}") for c in one.columns if c != "doc_id"]), "doc_id")
            parts[name] = json_object(_score(f"{name}__"), ("score",))
        summary = json_object({"complete": _json(F.col("complete")), **parts})
    linter = json_object({"engine": F.lit('"mechanical"'), "tool": _json(F.lit(mechanical[0])), "version": _json(F.lit(mechanical[1]))}) if mechanical else None
    judge = F.lit(None).cast("string") if model is None else F.when(F.lit(mechanical is None) | F.col("__ran"), model)
    graders = F.concat(F.lit("["), F.array_join(F.filter(F.array(*([linter] if mechanical else []), judge), lambda x: x.isNotNull()), ","), F.lit("]"))
    whole_json = json_object({"eval": _json(F.lit(kind)), "schema_version": _json(F.lit(VERSION)), "wof": _json(F.col("doc_id").cast("string")), "graded_at": _json(graded_at), "graders": graders, "summary": summary, "items": F.col("__items")})
    return out.select("doc_id", whole_json.alias("json"))


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines below ``path``/doc=ID, one folder per document."""
    results.select(F.col("doc_id").cast("string").alias("doc"), F.col("json").alias("value")).write.mode("overwrite").partitionBy("doc").text(path)


def model_json(name: str, provider: str, temperature: float, thinking: bool, votes: int, endpoint: str | None = None) -> Column:
    """A model grader in JSON; one vote at least."""
    values = {"engine": "model", "name": name, "provider": provider, "endpoint": endpoint, "temperature": float(temperature), "thinking": thinking, "votes": max(1, votes)}
    return json_object({k: _json(F.lit(v)) for k, v in values.items() if v is not None})


def write_party(declared: DataFrame, path: str) -> None:
    """The declared party as one JSON array; entries without a main name are left out."""
    one = F.struct("player", "main_name", "last_name", "aliases", "pronouns")
    rows = declared.where(F.trim("main_name") != "").agg(F.transform(F.array_sort(F.collect_list(F.struct("group", one.alias("e")))), lambda x: x["e"]).alias("all"))
    rows.select(F.to_json("all", {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def put_replies(replies: DataFrame, cache_path: str) -> None:
    """Appends replies that could be used (``model``, ``temperature``, ``max_tokens``, ``system``, ``user``, ``reply``, ``usable``) to the
    cache, under the key that :func:`with_keys` gives a request."""
    with_keys(replies.where("usable")).select("key", "reply").dropDuplicates(["key"]).write.mode("append").parquet(cache_path)


def with_keys(requests: DataFrame) -> DataFrame:
    """Requests with ``key``: SHA-256 of model, temperature, limit and both prompts, joined by NUL."""
    return requests.withColumn("key", cache_key("model", "temperature", "max_tokens", "system", "user"))


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with ``key`` and ``reply``, null where the cache has none: only those are to be asked."""
    return with_keys(requests).join(cache.groupBy("key").agg(F.min("reply").alias("reply")), "key", "left")
