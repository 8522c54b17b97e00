"""Differences between two copies of a table by characteristic-polynomial set reconciliation.

Every row is reduced to an element h of GF(2^61 - 1) below 2^60. A bucket (a hash of the key) of one copy is sketched
as the values of its characteristic polynomial prod(z - h) at a few points z >= 2^60, which no element can equal.
The quotient of both copies' values is a rational function whose numerator and denominator have exactly the rows
missing on the other side as roots. It is interpolated under a degree bound and held against two spare points; buckets
that fail get twice the bound, until all are verified. Then both copies evaluate the polynomials at their own elements;
the roots are the differing rows, which alone are fetched and compared field by field.

What is shuffled: the rows once each for picking the standing version of a key (combined before the shuffle, so a key
that holds a third of all rows is no hot task), sketches of some eight numbers per bucket of about 32 rows, and bucket, side
and element of the rows, without keys and fields, to meet the polynomials. Keys and fields are fetched for the roots: a bitmap
of ``BITS`` bits of the roots' elements, of the same size whatever their number, lets pass the rows that may be among them, and
only these are shuffled to meet the roots. Nothing grows on the driver; only the number of open buckets is counted there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.session import materialize

P = (1 << 61) - 1
SPARE = 2
#: Bits of the map that rows pass before they are fetched: 1 MB. With more roots than bits it passes most rows, and only costs more.
BITS = 1 << 23
_U = np.uint64


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod 2^61 - 1 for uint64 arrays below the modulus."""
    low, half = _U((1 << 31) - 1), _U(31)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid = ah * bl + al * bh
    s = ((ah * bh) << _U(1)) + (mid >> _U(30)) + ((mid & _U((1 << 30) - 1)) << half) + al * bl
    s = (s & _U(P)) + (s >> _U(61))
    return np.where(s >= _U(P), s - _U(P), s)


def points(n: int) -> np.ndarray:
    return np.arange(1 << 60, (1 << 60) + n, dtype=np.uint64)


def segment_product(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Product of the rows of ``values`` by id, halving each run of equal ids until one row is left."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    while True:
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1]
        if new.all():
            return ids, values
        start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        even = (np.arange(len(ids)) - start) % 2 == 0
        at = np.flatnonzero(even)
        follow = at + 1
        paired = np.zeros(len(at), bool)
        inside = follow < len(ids)
        paired[inside] = ~new[follow[inside]]
        kept = values[at]
        kept[paired] = mulmod(kept[paired], values[follow[paired]])
        ids, values = ids[at], kept


def _inverse(values: np.ndarray) -> np.ndarray:
    """Inverses of all entries by raising to p - 2."""
    out, base, e = np.ones_like(values), values, P - 2
    while e:
        if e & 1:
            out = mulmod(out, base)
        base, e = mulmod(base, base), e >> 1
    return out


def _sketcher(m: int, flush: int = 1 << 17):
    zs = points(m)

    def reduce(bucket: np.ndarray, side: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        factors = zs[None, :] - h[:, None]
        ids = bucket * 2 + side
        keys, prod = segment_product(ids, factors)
        _, counts = np.unique(ids, return_counts=True)
        flat = pa.array(prod.astype(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) * m + 1, m, dtype=np.int32)), flat)
        return pa.RecordBatch.from_arrays([pa.array(keys // 2), pa.array((keys % 2).astype(np.int32)), pa.array(counts.astype(np.int64)), lists], ["bucket", "side", "n", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            held.append((b["bucket"].to_numpy(), b["side"].to_numpy().astype(np.int64), b["h"].to_numpy().astype(np.uint64)))
            size += len(b)
            if size >= flush:
                yield reduce(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield reduce(*map(np.concatenate, zip(*held)))

    return run


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + (_U(P) - b))


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a + b >= _U(P), a + b - _U(P), a + b)


def lagrange(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients, lowest first, of prod(z - z_j) over the first m points, and of the Lagrange basis, a row for each point."""
    zs = [int(z) for z in points(m)]
    whole = [1]
    for z in zs:
        whole = [((whole[i - 1] if i else 0) - z * (whole[i] if i < len(whole) else 0)) % P for i in range(len(whole) + 1)]
    rows = []
    for z in zs:
        quotient, carry = [0] * m, 0
        for i in range(m, 0, -1):
            quotient[i - 1] = carry = (whole[i] + carry * z) % P
        at = 0
        for c in reversed(quotient):
            at = (at * z + c) % P
        inverse = pow(at, P - 2, P)
        rows.append([c * inverse % P for c in quotient])
    return np.array(whole, np.uint64), np.array(rows, np.uint64).reshape(m, m)


def _degree(a: np.ndarray) -> np.ndarray:
    """The place of the last coefficient that isn't 0 in each row, -1 if all are."""
    return np.where((a != 0).any(axis=1), a.shape[1] - 1 - (a[:, ::-1] != 0).argmax(axis=1), -1)


def _horner(a: np.ndarray, z: np.uint64) -> np.ndarray:
    at = np.zeros(len(a), np.uint64)
    for i in range(a.shape[1] - 1, -1, -1):
        at = _plus(mulmod(at, np.full(len(a), z)), a[:, i])
    return at


def rational(f: np.ndarray, delta: int, basis: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Monic p and q with p = q f at all points, deg p - deg q = delta, for each row of ``f`` (values at ``points``); None if there are none.

    ``basis`` is ``lagrange`` of all points but SPARE; both degrees together are below their number. Euclid's algorithm on the interpolated f,
    one step of the division at a time for all rows at once; the spare points then decide.
    """
    k, m = f.shape
    s = m - SPARE
    if abs(delta) >= s + (s == 0):
        return [None] * k  # more rows differ than the bound allows
    whole, base = basis
    value = np.zeros((k, s + 1), np.uint64)
    for j in range(s):
        value[:, :s] = _plus(value[:, :s], mulmod(np.repeat(f[:, j, None], s, axis=1), np.repeat(base[j][None], k, axis=0)))
    r = [np.repeat(whole[None], k, axis=0), value]
    t = [np.zeros((k, s + 1), np.uint64), np.zeros((k, s + 1), np.uint64)]
    t[1][:, 0] = 1
    most = (s - 1 + delta) // 2
    while len(at := np.flatnonzero(_degree(r[1]) > most)):
        high, low = _degree(r[0][at]), _degree(r[1][at])
        shift = np.arange(s + 1)[None] - (high - low)[:, None]
        over, under = (np.repeat(x[at, d][:, None], s + 1, axis=1) for x, d in ((r[1], low), (r[0], high)))
        for x in (r, t):
            moved = np.where(shift >= 0, np.take_along_axis(x[1][at], np.maximum(shift, 0), axis=1), _U(0))
            x[0][at] = _minus(mulmod(over, x[0][at]), mulmod(under, moved))
        swap = at[_degree(r[0][at]) < low]
        for x in (r, t):
            x[0][swap], x[1][swap] = x[1][swap], x[0][swap]
    p, q = r[1], t[1]
    dp, dq, each = _degree(p), _degree(q), np.arange(k)
    fine = (dp >= 0) & (dp - dq == delta) & (p[each, dp] == q[each, dq])
    inverse = np.repeat(_inverse(p[each, dp])[:, None], s + 1, axis=1)
    p, q = mulmod(p, inverse), mulmod(q, inverse)
    for j in range(s, m):
        z = points(m)[j]
        fine &= _horner(p, z) == mulmod(_horner(q, z), f[:, j].copy())
    return [(p[i, : dp[i] + 1], q[i, : dq[i] + 1]) if fine[i] else None for i in range(k)]


def _decoder(m: int):
    basis = lagrange(m - SPARE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b["bucket"].to_numpy(), b["side"].to_numpy(), b["n"].to_numpy(), b["values"].flatten().to_numpy().astype(np.uint64).reshape(-1, m)) for b in batches if len(b)]
        if not got:
            return
        bucket, side, n, values = map(np.concatenate, zip(*got))
        ids, inverse = np.unique(bucket, return_inverse=True)
        chi, count = np.ones((2, len(ids), m), np.uint64), np.zeros((2, len(ids)), np.int64)
        for s in (0, 1):
            of = side == s
            if of.any():
                at, prod = segment_product(inverse[of], values[of])
                chi[s, at] = prod
                np.add.at(count[s], inverse[of], n[of])
        differs = (chi[0] != chi[1]).any(axis=1) | (count[0] != count[1])
        ids, chi, delta = ids[differs], chi[:, differs], (count[0] - count[1])[differs]
        f = mulmod(chi[0], _inverse(chi[1]))
        found: list = [None] * len(ids)
        for d in np.unique(delta).tolist():
            of = np.flatnonzero(delta == d)
            for part in np.array_split(of, -(-len(of) * m * m // (1 << 19))):
                for i, pq in zip(part.tolist(), rational(f[part], d, basis)):
                    found[i] = pq
        lists = [pa.array([pq[k].astype(np.int64) if pq else [] for pq in found], pa.list_(pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([pq is not None for pq in found], pa.bool_()), *lists], ["bucket", "found", "p", "q"])

    return run


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose element is a root of their bucket's polynomial ``coefs``."""
    for b in batches:
        if not len(b):
            continue
        lists, h = b["coefs"], b["h"].to_numpy().astype(np.uint64)
        ends = lists.offsets.to_numpy().astype(np.int64)
        size, flat = np.diff(ends), lists.values.to_numpy().astype(np.uint64)
        value, widest = np.zeros(len(b), np.uint64), int(size.max())
        for k in range(widest - 1, -1, -1):
            has = size > k
            step = mulmod(value[has], h[has]) + flat[ends[:-1][has] + k]
            value[has] = np.where(step >= _U(P), step - _U(P), step)
        keep = b.filter(pa.array(value == 0))
        if len(keep):
            yield keep.drop_columns(["coefs"])


def _may_be(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows whose h shares its bit with an h of ``roots``."""
    place = F.col("h").bitwiseAND(F.lit(BITS - 1))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(BITS // 64, np.int64)
        for b in batches:
            words[b["w"].to_numpy()] = b["bits"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.list_(pa.int64()))], ["_words"])

    of = roots.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    one = materialize(of.coalesce(1).mapInArrow(dense, "_words array<long>"), "bitmap")
    return rows.join(F.broadcast(one), F.getbit(F.get("_words", word.cast("int")), bit) == 1, "left_semi")  # a single row


def standing(df: DataFrame, keys: dict[str, Column], fields: dict[str, Column], version: Column) -> DataFrame:
    """One row per key: of all deliveries the one with the latest version; ties go to the greatest field values.

    A null version is the earliest. The maximum is combined before the shuffle.
    """
    picked = F.max(F.struct(version.alias("_version"), *[c.alias(f"_f{i}") for i, c in enumerate(fields.values())])).alias("_row")
    rows = df.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(keys.values())]).agg(picked)
    return rows.select(*[f"_k{i}" for i in range(len(keys))], *[F.col("_row")[f"_f{i}"].alias(f"_f{i}") for i in range(len(fields))])


def differences(first: DataFrame, second: DataFrame, keys: dict[str, Column], fields: dict[str, Column], version: Column, degree_bound: int = 6, bucket_rows: int = 32) -> DataFrame:
    """Rows missing on either side and fields that differ between two copies.

    ``keys``, ``fields`` and ``version`` are named column expressions over either copy; the rows may have any other columns.
    Result: the keys under their names and ``difference``: ``only_first``, ``only_second`` or the name of a field. No repeated rows.

    Null in a key is a value like any other and agrees with null; null in a field differs from every value (map it first
    where it should agree with blank). Repeated rows and several versions of a key count once (``standing``). An empty
    copy leaves every key of the other as missing; two empty ones give no rows.
    ``degree_bound`` is the first bound on the differing rows of a bucket; it doubles until every bucket is verified, so the
    result doesn't depend on it. ``bucket_rows`` is the mean size of a bucket.
    """
    ks, fs = [f"_k{i}" for i in range(len(keys))], [f"_f{i}" for i in range(len(fields))]
    both = [standing(d, keys, fields, version).withColumn("side", F.lit(s)) for s, d in enumerate((first, second))]
    # A null and an empty string would hash alike, so nulls are marked.
    marks = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in ks + fs])
    rows = materialize(both[0].unionByName(both[1]).withColumn("h", F.xxhash64(marks, *ks, *fs).bitwiseAND(F.lit((1 << 60) - 1))).withColumn("_place", F.xxhash64(*ks)), "rows")
    n_buckets = max(1, rows.count() // (2 * bucket_rows))
    rows = rows.withColumn("bucket", F.pmod("_place", F.lit(n_buckets)))
    open_rows, solved, m = rows.select("bucket", "side", "h"), None, degree_bound
    while True:
        sketches = open_rows.mapInArrow(_sketcher(m + SPARE), "bucket long, side int, n long, values array<long>")
        decoded = materialize(sketches.repartition("bucket").mapInArrow(_decoder(m + SPARE), "bucket long, found boolean, p array<long>, q array<long>"), "decoded")
        done = decoded.filter("found").select("bucket", "p", "q")
        solved = done if solved is None else solved.unionByName(done)
        if decoded.filter("not found").isEmpty():
            break
        open_rows = rows.select("bucket", "side", "h").join(decoded.filter("not found").select("bucket"), "bucket", "left_semi")
        m *= 2
    coefs = F.when(F.col("side") == 0, F.col("p")).otherwise(F.col("q")).alias("coefs")
    candidates = rows.select("bucket", "side", "h").join(solved, "bucket").select("bucket", "side", "h", coefs)
    roots = materialize(candidates.mapInArrow(_roots, "bucket long, side int, h long"), "roots")
    differing = _may_be(rows, roots).join(roots, ["bucket", "side", "h"], "left_semi")
    sides = differing.groupBy(*ks).agg(*[F.max(F.when(F.col("side") == s, F.struct(*fs))).alias(f"_s{s}") for s in (0, 1)])
    a, b = F.col("_s0"), F.col("_s1")
    named = [F.when(a.isNotNull() & b.isNotNull() & ~a[f].eqNullSafe(b[f]), name) for f, name in zip(fs, fields)]
    difference = F.array(F.when(b.isNull(), "only_first"), F.when(a.isNull(), "only_second"), *named)
    return sides.select(*[F.col(k).alias(name) for k, name in zip(ks, keys)], F.explode(F.array_compact(difference)).alias("difference"))
