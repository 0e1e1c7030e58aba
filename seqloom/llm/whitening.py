"""Whitening of vectors, with the leading components found by slicing the spectrum.

A vector's entries become whole numbers ``floor(scale * c)``; the fit list holds every different
vector once. Its covariance ``V`` is summed in two distributed passes (exact integer sums, then
centred products). For each leading component the number of eigenvalues above a shift is
counted from the signs of the pivots of ``LDL^T`` of ``V - shift * I`` (Bunch-Kaufman pivoting;
Sylvester's law of inertia). Bisection by these counts isolates an eigenvalue in an interval of its own, Rayleigh
quotient iteration converges inside it, and counts on both sides of the result certify
its number; a result that fails its certificate is sought again in the halved interval. Eigenvalues that no
shift can part in double precision are one cluster, whose vectors come from block inverse iteration.

At scale: equal vectors combine before the shuffle, which moves each different vector once. Tasks add
up blocks of rows of ``V`` (d * d doubles a task, sent by row), and the driver holds one
d x d matrix and the sums, whatever the number of rows. Scoring is one narrow pass.

Defined cases: vectors that are null or hold null or non-finite entries are left out, and so are
those whose length is not the most frequent one (ties: the shorter); rows with a null id are
scored like others; components without variance (rounding apart) cannot be whitened and are not
returned, so equal rows or a single one give no rows, as does an empty table; an exact deviation beyond
64 bits is null; further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import stored

COMPONENTS = 4
SCALE = 256


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``id, x``: the valid vectors of the most frequent length as whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    rows = (vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.size("v") > 0)
            .where(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = common[0]["d"] if common else 0
    return rows.where(F.size("v") == d).select("id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c)).alias("x"))


def _matrix(column, dtype):
    import numpy as np

    return np.asarray(column.flatten()).astype(dtype).reshape(len(column), -1)


def _sums(batches):
    """Rows ``(dimension, high and low half of the exact sum)`` and the count of a task."""
    high = low = None
    n = 0
    for batch in batches:
        x = _matrix(batch.column(0), "int64")
        if not len(x):
            continue
        n += len(x)
        h, lo = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
        high, low = (h, lo) if high is None else (high + h, low + lo)
        high, low = high + (low >> 32), low & 0xFFFFFFFF
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(high)), pa.int32()), pa.array(high), pa.array(low), pa.array([n] * len(high), pa.int64())],
                                         ["i", "high", "low", "n"])


def fit_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    rows = (fit.select("x").mapInArrow(_sums, "i int, high long, low long, n long").groupBy("i")
            .agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum("n").alias("n")).collect())
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in sorted(rows, key=lambda r: r["i"])]


def _products(mean, weights):
    """Sums of products of centred rows, by row of the matrix; with ``weights`` (d x m) of the projected rows, and their sums as a last row."""
    def run(batches):
        import numpy as np

        m, w = np.asarray(mean), None if weights is None else np.asarray(weights)
        total = ends = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                y = _matrix(batch.column(0).slice(at, 4096), "float64") - m
                if w is not None:
                    y = y @ w
                p, s = y.T @ y, y.sum(0)
                total, ends = (p, s) if total is None else (total + p, ends + s)
        if total is not None:
            rows = [*total, ends]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["i", "v"])
    return run


def _added(table: pa.Table) -> pa.Table:
    import numpy as np

    rows = _matrix(table.column("v").combine_chunks(), "float64")
    rows = rows[np.lexsort(rows.T[::-1])] if len(rows) > 1 else rows  # an order of its own, so a rerun adds alike
    return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([rows.sum(0).tolist()], pa.list_(pa.float64()))})


def covariance(fit: DataFrame, n: int, mean, weights=None):
    """Covariance (divisor ``n``) of the vectors, or of their projections."""
    import numpy as np

    rows = (fit.select("x").mapInArrow(_products(mean.tolist(), None if weights is None else weights.tolist()), "i int, v array<double>")
            .groupBy("i").applyInArrow(_added, "i int, v array<double>").collect())
    m = np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])
    rest = m[-1] / n  # what rounding of the mean left
    return (m[:-1] + m[:-1].T) / (2 * n) - np.outer(rest, rest)


def count_above(a, shift: float) -> int:
    """How many eigenvalues of symmetric ``a`` exceed ``shift``: the positive pivots of ``LDL^T`` of
    ``a - shift * I`` with Bunch-Kaufman pivoting. A 2 x 2 pivot has one of either sign."""
    import numpy as np

    s = np.array(a, float)
    s[np.diag_indices_from(s)] -= shift
    alpha = (1 + 17 ** 0.5) / 8
    n, i, above = len(s), 0, 0

    def swap(p, q):
        if p != q:
            s[[p, q], i:] = s[[q, p], i:]
            s[i:, [p, q]] = s[i:, [q, p]]

    while i < n:
        d = abs(s[i, i])
        column = np.abs(s[i + 1:, i])
        most = column.max() if len(column) else 0.0
        two = False
        if most > 0 and d < alpha * most:
            r = i + 1 + int(column.argmax())
            other = np.abs(s[i:, r])
            other[r - i] = 0
            sigma = other.max()
            if d * sigma >= alpha * most * most:
                pass
            elif abs(s[r, r]) >= alpha * sigma:
                swap(i, r)
            else:
                swap(i + 1, r)
                two = True
        if two:
            block = s[i:i + 2, i:i + 2].copy()
            det = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            above += 1 if det < 0 else 2 * (block[0, 0] > 0)
            inverse = np.array([[block[1, 1], -block[0, 1]], [-block[1, 0], block[0, 0]]]) / det
            c = s[i + 2:, i:i + 2]
            s[i + 2:, i + 2:] -= c @ inverse @ c.T
            i += 2
        else:
            pivot = s[i, i]
            above += pivot > 0
            if pivot != 0:
                c = s[i + 1:, i]
                s[i + 1:, i + 1:] -= np.outer(c, c) / pivot
            i += 1
    return above


def leading_components(v, k: int):
    """Eigenvalues (falling) and unit eigenvectors (columns) of the ``k`` leading components of a
    covariance, fewer where the others have no variance."""
    import numpy as np

    d = len(v)
    scale = float(np.abs(v).sum(1).max()) if d else 0.0  # no eigenvalue is larger (Gershgorin)
    values: list[float] = []
    vectors = np.zeros((d, 0))
    if not scale > 0:
        return np.array(values), vectors
    eps = np.finfo(float).eps
    noise = 4 * d * eps * scale  # below, counts and residuals are rounding
    known: dict[float, int] = {}

    def count(x):
        if x not in known:
            known[x] = count_above(v, x)
        return known[x]

    k = min(k, d, count(noise))
    while len(values) < k:
        j = len(values)
        low, high = noise, min([x for x, c in known.items() if c <= j] + [scale + 2 * noise])
        low = max([x for x, c in known.items() if c > j and x < high] + [low])
        found = None
        while found is None:
            alone = count(low) - count(high) == 1 and count(high) == j
            if alone and high - low < 0.25 * max(abs(low), noise):
                found = _rayleigh(v, low, high, vectors, noise)
            if found is None:
                if high - low <= noise:
                    found = _cluster(v, (low + high) / 2, count(low) - j, vectors)
                    break
                middle = (low + high) / 2
                if count(middle) > j:
                    low = middle
                else:
                    high = middle
        e, u = found
        # certificate: as many eigenvalues as are numbered lie above, and with these all are below
        if count(e.min() - 2 * noise) < j + len(e) or count(e.max() + 2 * noise) > j:
            raise ArithmeticError(f"eigenvalue {j + 1} could not be certified")
        values += e.tolist()
        vectors = np.hstack([vectors, u])
    return np.array(values[:k]), vectors[:, :k]


def _orthogonal(u, against):
    import numpy as np

    for _ in range(2):
        u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0] if u.ndim == 2 else u / np.linalg.norm(u)


def _solve(m, u, noise):
    import numpy as np

    try:
        return np.linalg.solve(m, u)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue
        return np.linalg.solve(m + noise * np.eye(len(m)), u)


def _rayleigh(v, low, high, against, noise):
    """The eigenpair in ``(low, high)`` by Rayleigh quotient iteration, or None if it leaves the interval."""
    import numpy as np

    eye = np.eye(len(v))
    middle = v - (low + high) / 2 * eye
    u = _orthogonal(np.random.default_rng(len(v)).normal(size=len(v)), against)
    for _ in range(2):  # towards the eigenvector nearest the interval
        u = _orthogonal(_solve(middle, u, noise), against)
    best = None
    for _ in range(20):
        e = float(u @ v @ u)
        if not low - noise <= e <= high + noise:
            return None
        residual = float(np.linalg.norm(v @ u - e * u))
        if best is not None and residual >= best[0]:
            break
        best = residual, e, u
        u = _orthogonal(_solve(v - e * eye, u, noise), against)
    residual, e, u = best
    return (np.array([e]), u[:, None]) if residual <= 8 * noise else None


def _cluster(v, at, size, against):
    """``size`` eigenpairs about ``at`` that no shift parts, by block inverse iteration."""
    import numpy as np

    eye = np.eye(len(v))
    scale = np.abs(v).max()
    u = _orthogonal(np.random.default_rng(len(v)).normal(size=(len(v), size)), against)
    for _ in range(4):
        u = _orthogonal(_solve(v - at * eye, u, np.finfo(float).eps * scale), against)
    small = u.T @ v @ u
    # within the cluster any basis is one of eigenvectors; the block is nearly diagonal already
    e, r = np.linalg.eigh(small)
    return e[::-1], u @ r[:, ::-1]


def _score(n, sums, mean, weights, explained, error):
    def run(batches):
        import numpy as np

        s, m, w = np.array(sums, object), np.asarray(mean), np.asarray(weights)
        most = max([abs(x) for x in sums], default=0)
        k = w.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x = _matrix(part.column(1), "int64")
                y = (x.astype(float) - m) @ w
                far = float(np.abs(x.astype(float)).max(initial=0)) * n + most
                if far * far * max(x.shape[1], 1) < 2 ** 62:
                    z = x * n - s.astype("int64")
                    deviation = (z * z).sum(1).tolist()
                else:  # whole numbers of any size
                    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, sums)) for r in x.tolist()]
                    deviation = [a if a < 2 ** 63 else None for a in deviation]
                rows = len(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                     pa.array([n] * (rows * k), pa.int64()), pa.array([a for a in deviation for _ in range(k)], pa.int64()),
                     pa.array(y.ravel()), pa.array(np.tile(explained, rows)), pa.array([error] * (rows * k), pa.float64())],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Per valid row and component: id, ``component`` (from 1, by falling eigenvalue), ``n`` (size of the fit
    list), ``deviation`` (squared distance of ``n`` times the vector from the sums, exact), ``whitened``, ``explained`` (share of
    the trace) and ``identity_error`` (how far the whitened fit list's covariance is from the identity)."""
    import numpy as np

    rows = whole_vectors(vectors, id_col, vector_col, scale)
    fit = stored(rows.select("x").distinct(), "fit-list")
    n, sums = fit_sums(fit)
    mean = np.array([s / n for s in sums])
    v = covariance(fit, n, mean) if n else np.zeros((0, 0))
    e, u = leading_components(v, components)
    weights = u / np.sqrt(e)
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not len(e):
        return rows.where("false").select("id", *[F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in schema.split(", ")[1:]]).withColumnRenamed("id", id_col)
    error = float(np.abs(covariance(fit, n, mean, weights) - np.eye(len(e))).max())
    scored = rows.mapInArrow(_score(n, sums, mean.tolist(), weights.tolist(), (e / np.trace(v)).tolist(), error), schema)
    return scored.withColumnRenamed("id", id_col)
