"""Main text of HTML pages by a recurrent block labeller.

A bidirectional LSTM in numpy reads the page's whole sequence of leaf blocks, each a tag-path vector,
a hashed-word vector and plain measures, and labels every block from the states of both directions
there, so that each decision has the document's context.  Blocks labelled as main text are joined by
one space, in page order.  Pages are run in padded batches of similar length.

The weights are trained by quarry.llm.html_training, on generated pages of known labels only, and
kept beside this module.

Defined results: null and empty html give an empty text; pages without main blocks give an empty
text; repeated rows get equal texts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.html_blocks import DIMS, Block, leaf_blocks, vectors
from quarry.plans.columns import fresh, map_in_arrow, named
from quarry.plans.scratch import ship

WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "html_weights.npz")
HIDDEN = 24
#: Blocks in a padded batch, at most (one page has more if it must).
BATCH_BLOCKS = 6000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """Two LSTMs over the sequence, one in each direction, and a logistic layer on both states."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def fresh(seed: int = 5) -> "BiLSTM":
        rng = np.random.default_rng(seed)
        w = {}
        for d in ("f", "b"):
            w[f"x{d}"] = (rng.standard_normal((DIMS, 4 * HIDDEN)) * 0.1).astype(np.float32)
            w[f"h{d}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.1).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            w[f"c{d}"] = bias
        w["o"] = (rng.standard_normal(2 * HIDDEN) * 0.1).astype(np.float32)
        w["p"] = np.zeros(1, np.float32)
        return BiLSTM(w)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        n, steps, _ = x.shape
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c_new = f * c + i * g
            th = np.tanh(c_new)
            if trace is not None:
                trace.append((t, h, c, i, f, o, g, th, m))
            h, c = m * (o * th) + (1 - m) * h, m * c_new + (1 - m) * c
            out[:, t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Both directions in one loop, the backward one over reversed steps; gates by one tanh, as s(z) = (1 + tanh(z / 2)) / 2."""
        n, steps, _ = x.shape
        half = np.ones(4 * HIDDEN, np.float32)
        half[: 3 * HIDDEN] = 0.5
        pre = np.empty((steps, 2, n, 4 * HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            z = (x.reshape(n * steps, -1) @ (self.w[f"x{d}"] * half) + self.w[f"c{d}"] * half).reshape(n, steps, -1)
            pre[:, k] = (z if d == "f" else z[:, ::-1]).transpose(1, 0, 2)
        turn = np.stack([self.w["hf"] * half, self.w["hb"] * half])
        here = np.stack([mask, mask[:, ::-1]]).transpose(2, 0, 1)[..., None]
        whole = bool(mask.all())
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        out = np.empty((steps, 2, n, HIDDEN), np.float32)
        for t in range(steps):
            z = np.tanh(pre[t] + h @ turn)
            gate = z[..., : 3 * HIDDEN] * 0.5 + 0.5
            c_new = gate[..., HIDDEN : 2 * HIDDEN] * c + gate[..., :HIDDEN] * z[..., 3 * HIDDEN :]
            h_new = gate[..., 2 * HIDDEN :] * np.tanh(c_new)
            if whole:
                h, c = h_new, c_new
            else:
                m = here[t]
                h, c = m * h_new + (1 - m) * h, m * c_new + (1 - m) * c
            out[t] = h
        ahead = out[:, 0] @ self.w["o"][:HIDDEN]
        back = out[:, 1] @ self.w["o"][HIDDEN:]
        return (ahead + back[::-1]).T + self.w["p"]

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page's vectors whether each block is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            longest, take = len(pages[order[-1]]), []
            while order and (len(take) + 1) * longest <= max(BATCH_BLOCKS, longest):
                take.append(order.pop())
            x = np.zeros((len(take), longest, DIMS), np.float32)
            mask = np.zeros((len(take), longest), np.float32)
            for k, i in enumerate(take):
                x[k, : len(pages[i])] = pages[i]
                mask[k, : len(pages[i])] = 1
            z = self.logits(x, mask)
            for k, i in enumerate(take):
                out[i] = z[k, : len(pages[i])] > 0
        return out


def load(path: str = WEIGHTS) -> BiLSTM:
    with np.load(path) as f:
        return BiLSTM({k: f[k].astype(np.float32) for k in f.files})


def main_texts(model: BiLSTM, pages: list[str | None]) -> list[str]:
    blocks: list[list[Block]] = [leaf_blocks(p) for p in pages]
    labels = model.label([vectors(b) for b in blocks])
    return [" ".join(b.text for b, yes in zip(page, lab) if yes) for page, lab in zip(blocks, labels)]


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """pages' columns in ``keep`` (all but the html, if None) and the main text."""
    spark = pages.sparkSession
    ship(spark)
    names = [c for c in (pages.columns if keep is None else keep) if c not in (text_col, html_col if keep is None else None)]
    schema = T.StructType([*[pages.schema[c] for c in names], T.StructField(text_col, T.StringType(), False)])
    source = fresh("_html", [*names, text_col])
    bc = spark.sparkContext.broadcast(load().w)  # a fixed number of weights

    def run(batches):
        model = BiLSTM(bc.value)
        for batch in batches:
            for a in range(0, len(batch), 100):
                part = batch.slice(a, 100)
                texts = main_texts(model, part.column(source).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(texts, pa.string())], names=schema.names)

    return map_in_arrow(pages.select(*[named(pages, c) for c in names], named(pages, html_col).alias(source)), run, schema)
