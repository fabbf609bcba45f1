"""Vector search: exact nearest neighbours by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.paths import vector_id


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a, b) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.lit(1.0) - dot(a, b) / F.nullif(norms, F.lit(0.0))


def nearest(vectors: DataFrame, query: list[float], n: int = 5, vec: str = "embedding", key: str = "id") -> DataFrame:
    """The n nearest rows to one query with their distance; each task keeps n, so nothing is sorted as a whole."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", cosine_distance(F.col(vec), q)).orderBy("distance", key).limit(n)


def nearest_to_each(vectors: DataFrame, queries: DataFrame, n: int = 5, vec: str = "embedding", key: str = "id", query_key: str = "query_id", query_vec: str = "query_vec", block: int = 20_000) -> DataFrame:
    """The n nearest rows to each of a stated set of queries.

    Queries go in blocks of about ``block``, whatever their number; each block is sent to the tasks and meets all rows there. A task keeps n for each query
    before anything is shuffled, and the places are then settled by query. Rows and queries without a vector have no neighbours; a vector of zeros is at
    distance 1 of all; of equal distances the smaller id comes first; vectors of different lengths are an error.
    """
    q = queries.select(F.col(query_key).alias("query_id"), F.col(query_vec).alias("query_vec")).where("query_vec is not null")
    rows = vectors.select(F.col(key).alias("id"), F.col(vec).alias("v")).where("v is not null")
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, distance double"
    blocks = max(1, -(-q.count() // block))
    parts = [rows.mapInArrow(_nearest_in_task(vectors, q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k), n), schema) for k in range(blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("place", place).where(F.col("place") <= n)


def _smallest(d, n: int, name):
    """Places of the n smallest numbers of each row; of those at the last one the least names stay. name(row, place) is asked for ties only."""
    import numpy as np

    m = min(n, d.shape[1])
    top = np.argpartition(d, m - 1, axis=1)[:, :m]
    last = np.take_along_axis(d, top, 1).max(1)
    for r in np.flatnonzero((d <= last[:, None]).sum(1) > m).tolist():
        if np.isfinite(last[r]):
            top[r] = sorted(np.flatnonzero(d[r] <= last[r]).tolist(), key=lambda i: (d[r, i], name(r, i)))[:m]
    return top


def _nearest_in_task(vectors: DataFrame, queries: DataFrame, n: int):
    """A function of Arrow batches of (id, v) to the n nearest rows of the task to each query."""
    held = queries.toArrow()  # one block
    id_type = held.schema.field("query_id").type
    shared = vectors.sparkSession.sparkContext.broadcast((held.column("query_id").to_pylist(), held.column("query_vec").to_pylist()))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, asked = shared.value
        if not ids:
            return
        a = np.array(asked, np.float64)
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        best, who, kind = np.full((len(a), n), np.inf), np.full((len(a), n), None, object), None
        for b in batches:
            x = np.array(b.column("v").to_pylist(), np.float64).reshape(b.num_rows, -1)
            if not len(x):
                continue
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            kind, names = b.column("id").type, np.array(b.column("id").to_pylist(), object)
            for k in range(0, len(a), 256):
                z = slice(k, k + 256)
                d = 1.0 - a[z] @ x.T
                top = _smallest(d, n, lambda r, i: names[i])
                both, found = np.hstack([best[z], np.take_along_axis(d, top, 1)]), np.hstack([who[z], names[top]])
                keep = _smallest(both, n, lambda r, i: found[r, i])
                best[z], who[z] = np.take_along_axis(both, keep, 1), np.take_along_axis(found, keep, 1)
        for k in range(0, len(a) if kind is not None else 0, 4096):
            r, c = np.nonzero(np.isfinite(best[k : k + 4096]))
            yield pa.RecordBatch.from_arrays([pa.array([ids[k + i] for i in r.tolist()], id_type), pa.array(who[k + r, c].tolist(), kind), pa.array(best[k + r, c])], ["query_id", "id", "distance"])

    return run


def embedding_text(method, path, handler, parameters, dependencies, doc) -> Column:
    """What is embedded of an endpoint."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat_ws("\n", F.concat_ws(" ", c(method), c(path)), F.concat(F.lit("Handler: "), F.coalesce(c(handler), F.lit("anonymous"))), F.concat(F.lit("Parameters: "), F.coalesce(F.to_json(c(parameters)), F.lit("[]"))), F.concat(F.lit("Dependencies: "), F.coalesce(F.to_json(c(dependencies)), F.lit("{}"))), F.concat(F.lit("Doc: "), F.coalesce(c(doc), F.lit(""))))


def hashed_embedding(text, size: int = 64) -> Column:
    """A stand-in for an embedding model, which isn't available offline: counts of words hashed to ``size`` places."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("float"))


def index_endpoints(endpoints: DataFrame, text: str = "document") -> DataFrame:
    """id, document, embedding and metadata of the valid endpoints."""
    good = endpoints.where("method <> '' and path <> ''")
    return good.select(vector_id("method", "path").alias("id"), F.col(text).alias("document"), hashed_embedding(text).alias("embedding"), F.struct("method", "path", "file", "line").alias("metadata"))


def model_text(method, path, handler, summary, description, doc, parameters, tables, services, middleware, framework) -> Column:
    """What is embedded of a documented endpoint: the parts that aren't empty, a line each; the doc block up to 500 characters."""

    def named(name, x):
        return F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{name}: "), x))

    def listed(name, x):
        return F.when(F.size(x) > 0, F.concat(F.lit(f"{name}: "), F.array_join(x, ", ")))

    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat_ws("\n", F.concat_ws(" ", c(method), c(path)), named("Handler", c(handler)), named("Summary", c(summary)), named("Description", c(description)), named("Description", F.substring(c(doc), 1, 500)), F.when(F.size(c(parameters)) > 0, F.concat(F.lit("Parameters: "), F.to_json(c(parameters)))), listed("Tables", c(tables)), listed("Services", c(services)), listed("Middleware", c(middleware)), named("Framework", c(framework)))
