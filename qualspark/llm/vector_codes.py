"""Codes of vectors: each of equal parts by its nearest entry of that part's codebook, in integers only.

A component x counts as floor(scale * x). Distances are compared after an integer Walsh-Hadamard transform of the parts
and entries, padded with zeros to a power of two n: it multiplies squared distances by n and gathers most of them in the
coefficients of low sequency. Squared differences are added up in that order, and an entry goes as soon as its sum
exceeds the whole distance of the entry that looked nearest first, so the nearest entry is found exactly.

Tasks hold one batch of vectors and the codebooks (entries x dimension numbers). A round of refining shuffles one sum a
task for each number of the codebooks; those sums, and nothing else, reach the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized_broadcast

#: Vectors whose distances to all entries are held at once.
_CHUNK = 2048
#: Rows of label sums that may be broadcast; each is a label and a number.
_BROADCAST_ROWS = 1_000_000


def sequency_order(n: int) -> np.ndarray:
    """Places, in the transform's natural order, of the coefficients by number of sign changes; n a power of two."""
    bits = n.bit_length() - 1
    gray = [s ^ (s >> 1) for s in range(n)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray], dtype=np.int64)


def sequency_transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of the last axis, padded with zeros to a power of two, in order of sequency."""
    width = x.shape[-1]
    n = 1 << max(width - 1, 0).bit_length()
    out = np.zeros((*x.shape[:-1], n), dtype=x.dtype)
    out[..., :width] = x
    h = 1
    while h < n:
        pairs = out.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack((a + b, a - b), axis=-2).reshape(*x.shape[:-1], n)
        h *= 2
    return out[..., sequency_order(n)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, n times the squared distance) of the nearest entry of each row, both transformed; ties to the lower index."""
    n = x.shape[1]
    seen = (x[:, :1] - entries[:, 0][None, :]) ** 2
    guess = seen.argmin(axis=1)
    bound = ((x - entries[guess]) ** 2).sum(axis=1)
    row, col = np.nonzero(seen <= bound[:, None])
    part, at, step = seen[row, col], 1, 1
    while at < n:
        to = min(n, at + step)
        part = part + ((x[row, at:to] - entries[col, at:to]) ** 2).sum(axis=1)
        alive = part <= bound[row]
        row, col, part, at, step = row[alive], col[alive], part[alive], to, 2 * step
    # Every row keeps its guess at least; entries of a row stand in ascending order.
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else row
    least = np.minimum.reduceat(part, first) if len(row) else part
    hit = np.flatnonzero(part == np.repeat(least, np.diff(np.append(first, len(row)))))
    _, lowest = np.unique(row[hit], return_index=True)
    return col[hit[lowest]], least


def _scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles; Python integers where 64 bits may not hold what is made of them."""
    if not values.size or np.abs(values).max() < 2.0**40:
        return np.floor(values * scale).astype(np.int64)
    whole = [math.floor(x * scale) if abs(x) < 2.0**60 else int(x) * scale for x in values.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


def _wide(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if all sums of squares fit, otherwise as Python integers."""
    n = 1 << max(codebooks.shape[2] - 1, 0).bit_length()
    most = max((int(np.abs(a).max()) for a in (x, codebooks) if a.size), default=0)
    kind = np.int64 if 4 * n**3 * most**2 < 2**62 else object
    return x.astype(kind), codebooks.astype(kind)


def assign(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), a column a part, of integer vectors; codebooks: part x entry x position."""
    parts, _, width = codebooks.shape
    x, codebooks = _wide(x, codebooks)
    entries, n = sequency_transform(codebooks), 1 << max(width - 1, 0).bit_length()
    codes, far = np.zeros((len(x), parts), dtype=np.int64), np.zeros((len(x), parts), dtype=x.dtype)
    for low in range(0, len(x), _CHUNK):
        cut = sequency_transform(x[low : low + _CHUNK].reshape(-1, parts, width))
        for p in range(parts):
            codes[low : low + _CHUNK, p], scaled = nearest(cut[:, p], entries[p])
            far[low : low + _CHUNK, p] = scaled // n
    return codes, far


def _kept(column, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their components as doubles, a row each) of an Arrow array of lists."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.greater(pc.list_value_length(column), 0), False)))
    lists = column.take(pa.array(rows))
    sizes = np.asarray(pc.list_value_length(lists)) if len(rows) else np.zeros(0, np.int32)
    flat = lists.flatten()
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), math.nan))
    fine = np.ones(len(rows), dtype=bool)
    if len(rows):
        fine = np.logical_and.reduceat(np.isfinite(values), np.concatenate(([0], np.cumsum(sizes)[:-1])))
        values, rows, sizes = values[np.repeat(fine, sizes)], rows[fine], sizes[fine]
    if len(rows) and ((sizes != sizes[0]).any() or sizes[0] % parts):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    return rows, values.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def _first_vectors(vectors: DataFrame, entries: int, parts: int) -> np.ndarray:
    """The kept vectors of the smallest ids, one a row: at most `entries` of them."""

    def smallest(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            rows, values = _kept(batch.column(1), parts)
            ids = batch.column(0).take(pa.array(rows))
            if len(rows) > entries:
                at = pc.array_sort_indices(ids, null_placement="at_end")
                last = ids[at[entries - 1].as_py()]
                chosen = np.asarray(pc.fill_null(pc.less_equal(ids, last), False)) if last.is_valid else np.ones(len(rows), bool)
                ids, values = ids.filter(pa.array(chosen)), values[chosen]
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * values.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), pa.float64()))], ["id", "v"])

    kind = vectors.schema["id"].dataType.simpleString()
    least = vectors.select("id", "v").mapInArrow(smallest, f"id {kind}, v array<double>").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries)
    return np.array([r["v"] for r in least.collect()], dtype=np.float64)  # `entries` rows


def _refined(vectors: DataFrame, codebooks: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one round: each entry the floored mean of the parts that it is nearest to."""
    parts, entries, width = codebooks.shape

    def sums(batches):
        import pyarrow as pa

        total, count = np.zeros(codebooks.shape, dtype=object), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            rows, values = _kept(batch.column(1), parts)
            if not len(rows):
                continue
            x = _scaled(values, scale)
            codes, _ = assign(x, codebooks)
            small = int(np.abs(x).max()) * len(x) < 2**62
            own = np.zeros(codebooks.shape, dtype=np.int64 if small else object)
            for p in range(parts):
                np.add.at(own[p], codes[:, p], x[:, p * width : (p + 1) * width])
                count[p] += np.bincount(codes[:, p], minlength=entries)
            total += own.astype(object)
        p, e = np.nonzero(count)
        if len(p):
            slot = ((p * entries + e)[:, None] * width + np.arange(width)).ravel()
            added = [str(v) for v in total[p, e].ravel()]
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int32()), "s": pa.array(added, pa.string()), "n": pa.array(np.repeat(count[p, e], width), pa.int64())})

    rows = vectors.select("id", "v").mapInArrow(sums, "slot int, s string, n long")
    found = rows.groupBy("slot").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"), F.sum("n").alias("n")).collect()  # one row a number of the codebooks
    out = codebooks.astype(object).ravel()
    for r in found:
        out[r["slot"]] = int(r["s"]) // r["n"]
    return _narrow(out.reshape(codebooks.shape))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if not x.size or np.abs(x).max() < 2**62 else x


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in codebooks.ravel()).encode()).hexdigest()


def fit_codebooks(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray:
    """Codebooks (part x entry x position) from the first vectors by id, refined over all vectors. vectors: id, v."""
    first = _scaled(_first_vectors(vectors, entries, parts), scale)
    if not len(first):
        return np.zeros((parts, 0, 0), dtype=np.int64)
    codebooks = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        codebooks = _refined(vectors, codebooks, scale)
    return codebooks


def encode_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """Codes of all vectors: the id column, code, error, label_error, codebooks_sha256.

    `code` has an entry's index for each part, two hex digits each; `error` adds up the squared distances of the parts;
    `label_error` adds up errors of equal labels, nulls being one label. At most 256 entries. Vectors that are null, empty
    or hold a null, NaN or infinite component are left out; others must have one length, a multiple of `parts`, or the
    job fails. Null ids come last; rows that repeat an id all count, ordered by their components where an order matters.
    Fewer vectors than entries make a shorter codebook; an empty table gives no rows. Other columns are ignored. Numbers
    of any size are exact; an error above 64 bits fails, as the result could not hold it.
    """
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries apart")
    vectors = table.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    codebooks = fit_codebooks(vectors, parts, entries, rounds, scale)

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            rows, values = _kept(batch.column(1), parts)
            if not len(rows):
                continue
            codes, far = assign(_scaled(values, scale), codebooks)
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            error = [int(v) for v in far.sum(axis=1)]
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}
    coded = materialize(vectors.select("id", "v", "label").mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "vector-codes")
    # Labels may be as many as rows: their sums are broadcast only if few, and a hot label is split by the adaptive join else.
    sums = materialize(coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error")), "vector-labels")
    out = coded.join(sized_broadcast(sums, _BROADCAST_ROWS), F.col("label").eqNullSafe(F.col("_l")))
    return out.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))

