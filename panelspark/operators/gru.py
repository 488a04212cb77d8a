"""Sequence windows of monthly changes and a recurrent autoencoder over them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_index
from ..functions.ranks import clean
from ..spec import Settings


def valid_changes(df: DataFrame, seq: int = 11, entity: str = "entity", by: str = "eom") -> DataFrame:
    """n_valid: of the last ``seq`` calendar months, those with a row in the month before too."""
    w, m = Window.partitionBy(entity).orderBy(by), month_index(F.col(by))
    d = df.withColumn("_m", m).withColumn("_ok", F.coalesce((F.lag(m).over(w) == m - 1).cast("int"), F.lit(0)))
    return d.withColumn("n_valid", F.sum("_ok").over(Window.partitionBy(entity).orderBy("_m").rangeBetween(1 - seq, 0))).drop("_ok", "_m")


def windows(df: DataFrame, features: list[str], seq: int = 11, entity: str = "entity", by: str = "eom") -> DataFrame:
    """(entity, eom, changes, mask, n_valid): changes is seq rows of feature changes, oldest first, zeros where mask is 0.

    Rows of an entity are gathered by a range window over the month index, never as a dense cube.
    """
    w, m = Window.partitionBy(entity).orderBy(by), month_index(F.col(by))
    d = df.select(entity, by, m.alias("_m"), *[F.coalesce(clean(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    d = d.withColumn("_ok", F.coalesce(F.lag("_m").over(w) == F.col("_m") - 1, F.lit(False)))
    change = F.array(*[F.when(F.col("_ok"), F.col(c) - F.lag(c).over(w)).otherwise(0.0) for c in features])
    d = d.select(entity, by, "_m", F.struct("_m", F.col("_ok").alias("ok"), change.alias("x")).alias("s"))
    d = d.withColumn("_p", F.collect_list("s").over(Window.partitionBy(entity).orderBy("_m").rangeBetween(1 - seq, 0)))
    got = F.filter("_p", lambda s: s["ok"])
    zero = F.array(*[F.lit(0.0)] * len(features))
    d = d.withColumn("_at", F.map_from_entries(F.transform(got, lambda s: F.struct(s["_m"], s["x"])))).withColumn("n_valid", F.size("_at").cast("long"))  # by month: found, not searched for
    of = F.transform(F.sequence(F.lit(1 - seq), F.lit(0)), lambda o: F.try_element_at("_at", F.col("_m") + o))
    d = d.withColumn("_x", of)
    return d.select(entity, by, F.transform("_x", lambda x: F.coalesce(x, zero)).alias("changes"), F.transform("_x", lambda x: x.isNotNull().cast("int")).alias("mask"), "n_valid")


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Autoencoder:
    """One GRU layer to a code of d numbers and one GRU layer back; trained with AdamW on the masked squared error. numpy only."""

    def __init__(self, n_in: int, d: int, hidden: int, seq: int, seed: int):
        rng = np.random.default_rng(seed)
        u = lambda k, *shape: rng.uniform(-1 / np.sqrt(k), 1 / np.sqrt(k), shape)
        self.seq, self.hidden = seq, hidden
        self.p = {
            "ew": u(hidden, n_in, 3 * hidden), "eu": u(hidden, hidden, 3 * hidden), "eb": np.zeros(3 * hidden), "ec": np.zeros(3 * hidden), "zw": u(hidden, hidden, d), "zb": np.zeros(d),
            "dw": u(hidden, d, 3 * hidden), "du": u(hidden, hidden, 3 * hidden), "db": np.zeros(3 * hidden), "dc": np.zeros(3 * hidden), "ow": u(hidden, hidden, n_in), "ob": np.zeros(n_in),
        }

    def _run(self, xs: list[np.ndarray], w: str, u: str, b: str, c: str):
        """States and what the way back needs; gates in the order reset, update, new."""
        p, k = self.p, self.hidden
        h, kept = np.zeros((len(xs[0]), k)), []
        for x in xs:
            a, g = x @ p[w] + p[b], h @ p[u] + p[c]
            reset, update = _sigmoid(a[:, :k] + g[:, :k]), _sigmoid(a[:, k : 2 * k] + g[:, k : 2 * k])
            new = np.tanh(a[:, 2 * k :] + reset * g[:, 2 * k :])
            fresh = (1 - update) * new + update * h
            kept.append((x, h, reset, update, new, g[:, 2 * k :]))
            h = fresh
            yield h, kept

    def _back(self, grads: list[np.ndarray], kept: list, w: str, u: str, b: str, c: str, out: dict) -> list[np.ndarray]:
        p, dh, dx = self.p, np.zeros_like(kept[0][1]), []
        for (x, h, reset, update, new, gn), g in zip(reversed(kept), reversed(grads)):
            dh = dh + g
            dn = dh * (1 - update) * (1 - new**2)
            dz = dh * (h - new) * update * (1 - update)
            dr = dn * gn * reset * (1 - reset)
            da = np.concatenate([dr, dz, dn], 1)
            dg = np.concatenate([dr, dz, dn * reset], 1)
            out[w] += x.T @ da
            out[u] += h.T @ dg
            out[b] += da.sum(0)
            out[c] += dg.sum(0)
            dx.append(da @ p[w].T)
            dh = dh * update + dg @ p[u].T
        return dx[::-1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        h = None
        for h, _ in self._run([x[:, t] for t in range(self.seq)], "ew", "eu", "eb", "ec"):
            pass
        return h @ self.p["zw"] + self.p["zb"]

    def loss(self, x: np.ndarray, mask: np.ndarray, grad: bool = False):
        """Mean squared error over valid steps; with ``grad`` also the gradient."""
        p = self.p
        for h, ek in self._run([x[:, t] for t in range(self.seq)], "ew", "eu", "eb", "ec"):
            pass
        z = h @ p["zw"] + p["zb"]
        states = []
        for s, dk in self._run([z] * self.seq, "dw", "du", "db", "dc"):
            states.append(s)
        diff = np.stack([s @ p["ow"] + p["ob"] for s in states], 1) - x
        m = mask[:, :, None]
        n = max(1.0, float(mask.sum()) * x.shape[2])
        value = float((diff**2 * m).sum() / n)
        if not grad:
            return value
        out = {k: np.zeros_like(v) for k, v in p.items()}
        dy = 2 * diff * m / n
        back = []
        for t, s in enumerate(states):
            out["ow"] += s.T @ dy[:, t]
            out["ob"] += dy[:, t].sum(0)
            back.append(dy[:, t] @ p["ow"].T)
        dz = sum(self._back(back, dk, "dw", "du", "db", "dc", out))
        out["zw"] += h.T @ dz
        out["zb"] += dz.sum(0)
        last = [np.zeros_like(h) for _ in range(self.seq - 1)] + [dz @ p["zw"].T]
        self._back(last, ek, "ew", "eu", "eb", "ec", out)
        return value, out


Batches = Callable[[int], Iterator[tuple[np.ndarray, np.ndarray]]]


#: Training windows of one task in an epoch; a table with more is trained in several tasks whose weights are averaged after each epoch.
SHARD = 131_072


class Training:
    """A net with AdamW's moments and its count of steps: what goes from one epoch to the next."""

    def __init__(self, net: Autoencoder):
        self.net, self.step = net, 0
        self.m1, self.m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))

    def epoch(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], s: Settings, decay: float) -> int:
        """One pass; how many rows it read."""
        net, m1, m2, rows = self.net, self.m1, self.m2, 0
        for x, mask in batches:
            rows += len(x)
            _, g = net.loss(x, mask, True)
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            scale, self.step = min(1.0, s.gru_clip / (norm + 1e-12)), self.step + 1
            for k, v in g.items():
                v = v * scale
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                net.p[k] = net.p[k] * (1 - s.gru_lr * decay) - s.gru_lr * (m1[k] / (1 - 0.9**self.step)) / (np.sqrt(m2[k] / (1 - 0.999**self.step)) + 1e-8)
        return rows


def averaged(parts: list[tuple[int, Training]]) -> Training:
    """The mean of trainings, weighted by the rows that each has read."""
    total, out = sum(n for n, _ in parts), parts[0][1]
    if len(parts) == 1:
        return out
    mean = lambda of: {k: sum(n / total * of(t)[k] for n, t in parts) for k in out.net.p}
    out.m1, out.m2, out.net.p = mean(lambda t: t.m1), mean(lambda t: t.m2), mean(lambda t: t.net.p)
    out.step = max(t.step for _, t in parts)
    return out


def measured(net: Autoencoder, batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """(sum of the loss over valid steps, valid steps)."""
    total = [(net.loss(x, m) * m.sum(), m.sum()) for x, m in batches]
    return float(sum(a for a, _ in total)), float(sum(b for _, b in total))


def stored(uri: str, size: int, seed: int) -> Batches:
    """Batches of a table (changes, mask) in the shared folder: files, and rows within some 50 batches of a file, in another order each epoch."""

    def batches(epoch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        rng = np.random.default_rng([seed, epoch])
        system, root = fs.FileSystem.from_uri(uri)
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
        for i in rng.permutation(len(files)):
            with system.open_input_file(files[i]) as f:
                for b in pq.ParquetFile(f).iter_batches(50 * size):
                    n = b.num_rows
                    mask = np.asarray(b["mask"].flatten(), float).reshape(n, -1)
                    x = np.asarray(b["changes"].flatten().flatten(), float).reshape(n, mask.shape[1], -1)
                    order = rng.permutation(n)
                    for at in range(0, n, size):
                        yield x[order[at : at + size]], mask[order[at : at + size]]

    return batches


def embed(win: DataFrame, d: int, train, val, s: Settings = Settings(), entity: str = "entity", by: str = "eom") -> DataFrame:
    """(entity, eom, gru_1..d) for every row of windows(); null where fewer than min_valid changes are valid, NaN without rows to train on.

    Trained on every valid training window: each epoch is a job with a task a weight decay and shard of at most some SHARD windows, which goes through its shard from the weights of the epoch
    before; their weights are averaged. A table of one shard is trained as by one machine. A decay ends when its loss on all validation windows has not fallen for ``patience`` epochs; all
    rows are encoded with the best epoch of the decay whose loss is least.
    """
    import pickle

    from ..sources.tables import Materializer

    spark, keep = win.sparkSession, Materializer(win.sparkSession)
    wanted = [F.coalesce(c, F.lit(False)) & (F.col("n_valid") >= s.seq_min_valid) for c in (train, val)]
    every = keep.scratch(win.select("*", wanted[0].alias("_t"), wanted[1].alias("_v")), "windows")
    sizes = every.agg(F.count_if("_t").alias("_t"), F.count_if("_v").alias("_v")).first()
    out = every.select(entity, by, "changes", "n_valid")
    if not sizes["_t"] or not sizes["_v"]:
        return out.select(entity, by, *[F.lit(float("nan")).alias(f"gru_{i + 1}") for i in range(d)])
    first = every.where("_t").select(F.size(F.col("changes")[0]).alias("k"), F.size("mask").alias("n")).first()
    shape = (first["k"], first["n"])

    def shards(name: str) -> list[str]:
        """Where the windows of a kind lie, dealt into shards by their keys."""
        rows, n = every.where(name), -(-sizes[name] // SHARD)
        if n == 1:
            return [keep.path_of(rows.select("changes", "mask"), f"gru{name}")]
        dealt = rows.select("changes", "mask", entity, by, F.pmod(F.xxhash64(entity, by), F.lit(n)).cast("int").alias("shard"))
        dealt = dealt.repartition(n, "shard").sortWithinPartitions("shard", entity, by).drop(entity, by)
        path = f"{keep.root}/gru{name}-{uuid.uuid4().hex}"
        dealt.write.partitionBy("shard").parquet(path)
        return [f"{path}/shard={i}" for i in range(n)]

    paths = {name: shards(name) for name in ("_t", "_v")}

    def each(jobs: list[tuple[int, int]], run: Callable[[int, int], tuple[float, bytes]]) -> DataFrame:
        """(decay_no, shard, n, made) of run(decay_no, shard), a task a job."""

        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            np.empty(1 << 22)  # freed at once: arrays below this size are from here on reused in place of being mapped anew
            for f in frames:
                for i in f["id"]:
                    n, made = run(*jobs[i])
                    yield pd.DataFrame({"decay_no": [jobs[i][0]], "shard": [jobs[i][1]], "n": [float(n)], "made": [made]})

        return spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(task, "decay_no int, shard int, n double, made binary")

    def mean(f: pd.DataFrame) -> pd.DataFrame:
        """One net a shard, a few hundred kilobytes each."""
        f = f.sort_values("shard")
        made = averaged([(n, pickle.loads(b)) for n, b in zip(f["n"], f["made"])])
        return pd.DataFrame({"decay_no": f["decay_no"].iloc[:1], "made": [pickle.dumps(made)]})

    start = pickle.dumps(Training(Autoencoder(shape[0], d, s.gru_hidden, shape[1], s.seed)))
    now = {i: start for i in range(len(s.gru_decay))}  # a net a decay
    best = {i: (np.inf, start) for i in now}
    stale = dict.fromkeys(now, 0)
    for epoch in range(s.gru_epochs):
        going = [i for i in now if stale[i] < s.gru_patience]
        if not going:
            break
        sent = spark.sparkContext.broadcast({i: now[i] for i in going})

        def trained(i: int, k: int, sent=sent, epoch=epoch) -> tuple[float, bytes]:
            made = pickle.loads(sent.value[i])
            rows = made.epoch(stored(paths["_t"][k], s.gru_batch, s.seed + k)(epoch), s, float(s.gru_decay[i]))
            return rows, pickle.dumps(made)

        made = each([(i, k) for k in range(len(paths["_t"])) for i in going], trained)
        now |= {r["decay_no"]: bytes(r["made"]) for r in made.groupBy("decay_no").applyInPandas(mean, "decay_no int, made binary").collect()}
        after = spark.sparkContext.broadcast({i: now[i] for i in going})

        def told(i: int, k: int, after=after) -> tuple[float, bytes]:
            return 0.0, pickle.dumps(measured(pickle.loads(after.value[i]).net, stored(paths["_v"][k], s.gru_batch, s.seed)(0)))

        losses: dict[int, list] = {i: [] for i in going}
        for r in each([(i, k) for k in range(len(paths["_v"])) for i in going], told).orderBy("shard").collect():  # two numbers a shard
            losses[r["decay_no"]].append(pickle.loads(bytes(r["made"])))
        for i, parts in losses.items():
            value = sum(a for a, _ in parts) / max(1.0, sum(b for _, b in parts))
            if value < best[i][0] - 1e-9:
                best[i], stale[i] = (value, now[i]), 0
            else:
                stale[i] += 1
    chosen = min(best, key=lambda i: (best[i][0], s.gru_decay[i]))
    net_sent = spark.sparkContext.broadcast(best[chosen][1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.empty(1 << 22)
        net = pickle.loads(net_sent.value).net
        for b in batches:
            if b.num_rows:
                z = net.encode(np.asarray(b["changes"].flatten().flatten(), float).reshape(b.num_rows, shape[1], shape[0]))
                z[np.asarray(b["n_valid"]) < s.seq_min_valid] = np.nan
                yield pa.RecordBatch.from_arrays([b[entity], b[by], *[pa.array(v, from_pandas=True) for v in z.T]], names=[entity, by, *[f"gru_{i + 1}" for i in range(d)]])

    kinds = {f.name: f.dataType.simpleString() for f in win.schema}
    return out.mapInArrow(encode, f"{entity} {kinds[entity]}, {by} {kinds[by]}, " + ", ".join(f"gru_{i + 1} double" for i in range(d)))
