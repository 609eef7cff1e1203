"""A convolutional recurrent forecaster of frames, trained data-parallel on Spark.

An encoder reads the history of frames, a decoder emits the next ones from its own
output; both are convolutional LSTM cells with 3 x 3 kernels.  In every round tasks add
up gradients over the windows they hold, from weights that are broadcast; the driver
sums one row a task and takes an Adam step.  The weights with the least error on the
validation windows are kept.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityloom.operators.forecast import chronological_split
from cityloom.sources.lineage import Shared, stored
from cityloom.sources.outputs import put


#: Tasks that share a round's windows; each sends back one gradient.
TASKS = 64


@dataclass
class Model:
    height: int
    width: int
    history: int = 12
    horizon: int = 3
    hidden: int = 32
    scale: float = 1.0
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def fresh(self, seed: int = 42) -> Model:
        rng, k = np.random.default_rng(seed), self.hidden
        for part in ("encoder", "decoder"):
            self.weights[f"{part}_w"] = rng.normal(0, 1 / np.sqrt(9 * (1 + k)), (9 * (1 + k), 4 * k))
            self.weights[f"{part}_b"] = np.concatenate([np.zeros(k), np.ones(k), np.zeros(2 * k)])  # forget gates open
        self.weights |= {"out_w": rng.normal(0, 1 / np.sqrt(k), (k, 1)), "out_b": np.zeros(1)}
        return self


def _unfold(x: np.ndarray) -> np.ndarray:
    """The 3 x 3 surroundings of each place of (batch, rows, columns, channels)."""
    h, w = x.shape[1:3]
    p = np.pad(x, ((0, 0), (1, 1), (1, 1), (0, 0)))
    return np.concatenate([p[:, i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=3)


def _fold(g: np.ndarray, channels: int) -> np.ndarray:
    """The transpose of _unfold()."""
    b, h, w, _ = g.shape
    out = np.zeros((b, h + 2, w + 2, channels))
    for n in range(9):
        i, j = divmod(n, 3)
        out[:, i : i + h, j : j + w] += g[..., n * channels : (n + 1) * channels]
    return out[:, 1:-1, 1:-1]


def _gate(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _cell(x, h, c, w, b):
    k = h.shape[3]
    seen = _unfold(np.concatenate([x, h], axis=3))
    z = seen @ w + b
    i, f, o, g = _gate(z[..., :k]), _gate(z[..., k : 2 * k]), _gate(z[..., 2 * k : 3 * k]), np.tanh(z[..., 3 * k :])
    new = f * c + i * g
    t = np.tanh(new)
    return o * t, new, (seen, i, f, o, g, c, t)


def _cell_back(dh, dc, kept, w):
    seen, i, f, o, g, c, t = kept
    dc = dc + dh * o * (1 - t * t)
    dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)], axis=3)
    dseen = _fold(dz @ w.T, 1 + i.shape[3])
    return dseen[..., :1], dseen[..., 1:], dc * f, np.tensordot(seen, dz, axes=([0, 1, 2], [0, 1, 2])), dz.sum(axis=(0, 1, 2))


def forward(model: Model, x: np.ndarray):
    """Predictions (batch, horizon, rows, columns) of scaled histories (batch, history, rows, columns)."""
    w, shape = model.weights, (*x.shape[:1], *x.shape[2:], model.hidden)
    h, c, kept, out = np.zeros(shape), np.zeros(shape), [], []
    for t in range(x.shape[1]):
        h, c, k = _cell(x[:, t, :, :, None], h, c, w["encoder_w"], w["encoder_b"])
        kept.append(k)
    last = x[:, -1, :, :, None]
    for _ in range(model.horizon):
        h, c, k = _cell(last, h, c, w["decoder_w"], w["decoder_b"])
        last = h @ w["out_w"] + w["out_b"]
        kept.append((k, h))
        out.append(last[..., 0])
    return np.stack(out, axis=1), kept


def gradient(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Sum of squared errors, and its gradient by backpropagation through time."""
    w = model.weights
    guess, kept = forward(model, x)
    gap = guess - y
    grads = {n: np.zeros_like(v) for n, v in w.items()}
    dh = dc = np.zeros((*x.shape[:1], *x.shape[2:], model.hidden))
    dlast = np.zeros((*gap.shape[:1], *gap.shape[2:], 1))
    for t in reversed(range(model.horizon)):
        k, h = kept[len(kept) - model.horizon + t]
        dout = 2 * gap[:, t, :, :, None] + dlast
        grads["out_w"] += np.tensordot(h, dout, axes=([0, 1, 2], [0, 1, 2]))
        grads["out_b"] += dout.sum(axis=(0, 1, 2))
        dlast, dh, dc, dw, db = _cell_back(dh + dout @ w["out_w"].T, dc, k, w["decoder_w"])
        grads["decoder_w"] += dw
        grads["decoder_b"] += db
    for k in reversed(kept[: len(kept) - model.horizon]):
        _, dh, dc, dw, db = _cell_back(dh, dc, k, w["encoder_w"])
        grads["encoder_w"] += dw
        grads["encoder_b"] += db
    return float((gap * gap).sum()), grads


def windows(frames: DataFrame, height: int, width: int, history: int, horizon: int) -> DataFrame:
    """frame (the last one seen), seen and ahead: arrays of dense frames, one row a window.

    frames: frame, cell (row * width + column), value; absent cells are 0.  A window's
    frames fit in a row; frames are ordered in one task, as arrays of the grid's size.
    """
    cells = F.sequence(F.lit(0).cast("long"), F.lit(height * width - 1).cast("long"))
    dense = frames.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct(F.col("cell").cast("long"), F.col("value").cast("float")))).alias("m"))
    dense = stored(dense.select("frame", F.transform(cells, lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0).cast("float"))).alias("values")), "frames")
    # Windows are made by shifted equi joins on the frames' numbers, not by a global window.
    order = stored(dense.select("frame").withColumn("n", F.row_number().over(Window.orderBy("frame"))), "frame-order")  # a number a frame
    numbered = dense.join(order, "frame")
    parts = numbered.select(F.explode(F.sequence(F.col("n") - horizon, F.col("n") + history - 1)).alias("at"), "n", "values")
    made = parts.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "values"))), lambda r: r["values"]).alias("all")).where(F.size("all") == history + horizon)
    made = made.join(order.withColumnRenamed("n", "at"), "at")
    return made.select("frame", F.slice("all", 1, history).alias("seen"), F.slice("all", history + 1, horizon).alias("ahead"))


def _arrays(frame: pd.DataFrame, name: str, model: Model) -> np.ndarray:
    return np.array([np.stack(v) for v in frame[name]], dtype=float).reshape(len(frame), -1, model.height, model.width) / model.scale


def _pass(rows: DataFrame, model: Model, back: bool) -> tuple[float, int, dict[str, np.ndarray]]:
    """Squared error, number of values and (back) gradient over all windows."""
    shared = Shared(rows.sparkSession, model)

    def run(batches):
        model = shared.value
        loss, n, total = 0.0, 0, {k: np.zeros_like(v) for k, v in model.weights.items()}
        for batch in batches:
            for i in range(0, len(batch), 8):
                part = batch.iloc[i : i + 8]
                x, y = _arrays(part, "seen", model), _arrays(part, "ahead", model)
                if back:
                    one, grads = gradient(model, x, y)
                    for k in total:
                        total[k] += grads[k]
                else:
                    one = float(((forward(model, x)[0] - y) ** 2).sum())
                loss, n = loss + one, n + y.size
        flat = np.concatenate([v.ravel() for v in total.values()]) if back else np.zeros(0)
        yield pd.DataFrame({"loss": [loss], "n": [n], "grads": [flat.tobytes()]})

    loss, n, flat = 0.0, 0, None
    for r in rows.select("seen", "ahead").coalesce(TASKS).mapInPandas(run, "loss double, n long, grads binary").collect():  # one row a task
        loss, n = loss + r.loss, n + r.n
        part = np.frombuffer(r.grads)
        flat = part if flat is None else flat + part
    shared.destroy()
    out, at = {}, 0
    if back and flat is not None:
        for k, v in model.weights.items():
            out[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
    return loss, n, out


def train(made: DataFrame, model: Model, epochs: int = 20, rate: float = 1e-2, seed: int = 42) -> tuple[Model, list[dict]]:
    """The model with the least validation error, and losses by epoch; made: windows()."""
    parts = stored(made.join(chronological_split(made), "frame"), "windows")
    training, checking = parts.where("part = 'train'"), parts.where("part = 'validate'")
    top = training.select(F.max(F.expr("array_max(transform(seen, f -> array_max(f)))"))).first()[0]
    model.scale = float(top) if top and top > 1e-6 else 1.0
    model.weights = model.weights or model.fresh(seed).weights
    moment, square = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    best, least, told = None, float("inf"), []
    for t in range(1, epochs + 1):
        loss, n, grads = _pass(training, model, True)
        for k, g in grads.items():
            g = g / max(1, n)
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            model.weights[k] = model.weights[k] - rate * (moment[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
        checked, m, _ = _pass(checking, model, False)
        told.append({"epoch": t, "train_mse": loss / max(1, n), "val_mse": checked / max(1, m)})
        if told[-1]["val_mse"] < least:
            least, best = told[-1]["val_mse"], {k: v.copy() for k, v in model.weights.items()}
    model.weights = best or model.weights
    return model, told


def predict(made: DataFrame, model: Model) -> DataFrame:
    """frame (the last seen), step (1 to horizon), cell, predicted, value (null where unknown)."""
    shared = Shared(made.sparkSession, model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for i in range(0, len(batch), 8):
                part = batch.iloc[i : i + 8]
                guess = np.maximum(forward(model, _arrays(part, "seen", model))[0] * model.scale, 0.0)
                b, s, h, w = guess.shape
                at, step, cell = np.unravel_index(np.arange(guess.size), (b, s, h * w))
                truth = (_arrays(part, "ahead", model) * model.scale).ravel() if part["ahead"].iloc[0] is not None and len(part["ahead"].iloc[0]) else np.full(guess.size, np.nan)
                yield pd.DataFrame({"frame": part["frame"].to_numpy()[at], "step": step + 1, "cell": cell, "predicted": guess.ravel(), "value": truth})

    return made.mapInPandas(run, "frame long, step long, cell long, predicted double, value double").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def predict_tail(frames: DataFrame, model: Model) -> DataFrame:
    """predict() from the last frames there are."""
    made = windows(frames, model.height, model.width, model.history, 0)
    last = made.agg(F.max("frame")).first()[0]
    return predict(made.where(F.col("frame") == last), model)


def save(model: Model, path: str) -> None:
    """A checkpoint (npz) of weights and configuration."""
    out = io.BytesIO()
    np.savez(out, _shape=np.array([model.height, model.width, model.history, model.horizon, model.hidden]), _scale=np.array(model.scale), **model.weights)
    put(path, out.getvalue())


def load(spark, path: str) -> Model:
    """A checkpoint read back through Spark's file systems."""
    content = spark.read.format("binaryFile").load(path).select("content").first().content
    held = np.load(io.BytesIO(content), allow_pickle=False)
    shape = [int(v) for v in held["_shape"]]
    return Model(*shape, scale=float(held["_scale"]), weights={k: held[k] for k in held.files if not k.startswith("_")})
