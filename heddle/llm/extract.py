"""Main text of web pages: a bidirectional LSTM labels every leaf block with the whole page in view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.blocks import MAIN, REST, Block, Pages, blocks_of
from heddle.llm.bpe import slices

#: Widths of the hashed tag path, the hashed words, and the recurrent state of one direction.
PATH, WORDS, STATE = 192, 32, 24
#: Training: synthetic pages, pages in a batch, passes, step size, seed.
PAGES, BATCH, PASSES, RATE, SEED = 1500, 24, 6, 0.015, 7
#: Pages that run through the labeller together, the cells (pages by blocks of the longest) that they may fill, and blocks
#: of a page that would fill more by itself and so runs in stretches that hand on the state.
TOGETHER, CELLS, STRETCH = 128, 1 << 15, 1 << 12

_NUMBERS = 7


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Signed hashed counts of the elements and class words around a block; inner ones once more with their depth."""
    out = np.zeros(PATH, np.float32)
    for up, label in enumerate(reversed(path)):
        tag, *words = label.split(".")
        tokens = [f"{tag}", *(f".{w}" for w in words)]
        if up < 2:
            tokens += [f"{up}{t}" for t in tokens]
        for token in tokens:
            h = zlib.crc32(token.encode())
            out[h % PATH] += 1.0 if h >> 16 & 1 else -1.0
    return np.clip(out, -2, 2)


def features(blocks: list[Block], low: int = 0, high: int | None = None) -> np.ndarray:
    """One row for each block from ``low`` to ``high`` of a page: tag path, hashed words, sizes and shares."""
    some = blocks[low:high]
    out = np.zeros((len(some), PATH + WORDS + _NUMBERS), np.float32)
    for k, block in enumerate(some):
        words = block.text.lower().encode().split()
        hashed = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % WORDS
        out[k, :PATH] = _path_vector(block.path)
        out[k, PATH : PATH + WORDS] = np.bincount(hashed, minlength=WORDS) / max(1, len(words)) ** 0.5 / 4
        out[k, PATH + WORDS :] = (
            np.log1p(len(words)) / 3,
            np.log1p(len(block.text)) / 5,
            block.linked,
            block.text[-1] in ".!?",
            (low + k) / len(blocks),
            len(block.path) / 8,
            1.0,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _run(x: np.ndarray, mask: np.ndarray, weights: tuple[np.ndarray, np.ndarray], keep: bool = False, carry: list | None = None):
    """States (steps, pages, STATE) of one direction; with ``keep`` also what its gradient needs.

    ``carry`` holds the state that a stretch begins with (empty at first) and takes the one that it ends with.
    """
    wx, wh = weights
    steps, pages, _ = x.shape
    driven = x @ wx
    h, c = carry or (np.zeros((pages, STATE), np.float32), np.zeros((pages, STATE), np.float32))
    out, kept = np.zeros((steps, pages, STATE), np.float32), []
    for t in range(steps):
        z = driven[t] + h @ wh
        gates, fresh = _sigmoid(z[:, : 3 * STATE]), np.tanh(z[:, 3 * STATE :])
        i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
        m = mask[t][:, None]
        new_c = f * c + i * fresh
        curved = np.tanh(new_c)
        if keep:
            kept.append((h, c, i, f, o, fresh, curved, m))
        h, c = m * o * curved + (1 - m) * h, m * new_c + (1 - m) * c
        out[t] = h
    if carry is not None:
        carry[:] = h, c
    return (out, kept) if keep else out


def _gradient(x: np.ndarray, kept: list, wh: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Back-propagation through time for one direction."""
    d_wh = np.zeros_like(wh)
    d_z = np.zeros((*x.shape[:2], 4 * STATE), np.float32)
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, fresh, curved, m = kept[t]
        dh = dh + d_out[t]
        d_new, d_c = m * dh, m * dc
        d_c = d_c + d_new * o * (1 - curved**2)
        z = np.concatenate(
            [d_c * fresh * i * (1 - i), d_c * c * f * (1 - f), d_new * curved * o * (1 - o), d_c * i * (1 - fresh**2)], 1
        )
        d_z[t] = z
        d_wh += h.T @ z
        dh, dc = (1 - m) * dh + z @ wh.T, (1 - m) * dc + d_c * f
    return np.tensordot(x, d_z, ((0, 1), (0, 1))), d_wh


class Labeller:
    """Weights of two directions and a logistic output over both states."""

    def __init__(self, seed: int = SEED):
        r, width = np.random.default_rng(seed), PATH + WORDS + _NUMBERS
        draw = lambda *shape: (r.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)
        self.p = [draw(width, 4 * STATE), draw(STATE, 4 * STATE), draw(width, 4 * STATE), draw(STATE, 4 * STATE), draw(2 * STATE, 1), np.zeros(1, np.float32)]

    @staticmethod
    def pack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, rows))
        x, mask = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32), np.zeros((steps, len(rows)), np.float32)
        for k, row in enumerate(rows):
            x[: len(row), k], mask[: len(row), k] = row, 1
        return x, mask

    def scores(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Log odds of being main text, for each block of each page."""
        x, mask = self.pack(rows)
        ahead = _run(x, mask, (self.p[0], self.p[1]))
        back = _run(x[::-1], mask[::-1], (self.p[2], self.p[3]))[::-1]
        z = (np.concatenate([ahead, back], 2) @ self.p[4])[..., 0] + self.p[5]
        return [z[: len(row), k] for k, row in enumerate(rows)]

    def long_scores(self, blocks: list[Block]) -> np.ndarray:
        """The log odds of one long page: what it needs at a time is a stretch's features and every block's states."""
        lows = range(0, len(blocks), STRETCH)
        states = np.zeros((len(blocks), 2 * STATE), np.float32)
        ahead: list = []
        for low in lows:
            x = features(blocks, low, low + STRETCH)[:, None]
            states[low : low + STRETCH, :STATE] = _run(x, np.ones(x.shape[:2], np.float32), (self.p[0], self.p[1]), carry=ahead)[:, 0]
        back: list = []
        for low in reversed(lows):
            x = features(blocks, low, low + STRETCH)[::-1, None]
            states[low : low + STRETCH, STATE:] = _run(x, np.ones(x.shape[:2], np.float32), (self.p[2], self.p[3]), carry=back)[::-1, 0]
        return (states @ self.p[4])[:, 0] + self.p[5]

    def gradients(self, rows: list[np.ndarray], labels: list[np.ndarray]) -> list[np.ndarray]:
        x, mask = self.pack(rows)
        y = np.zeros(mask.shape, np.float32)
        for k, own in enumerate(labels):
            y[: len(own), k] = own
        ahead, kept_a = _run(x, mask, (self.p[0], self.p[1]), True)
        back, kept_b = _run(x[::-1], mask[::-1], (self.p[2], self.p[3]), True)
        both = np.concatenate([ahead, back[::-1]], 2)
        d = (_sigmoid((both @ self.p[4])[..., 0] + self.p[5]) - y) * mask / mask.sum()
        d_both = d[..., None] * self.p[4][:, 0]
        g0, g1 = _gradient(x, kept_a, self.p[1], d_both[..., :STATE])
        g2, g3 = _gradient(x[::-1], kept_b, self.p[3], d_both[::-1, :, STATE:])
        return [g0, g1, g2, g3, np.tensordot(both, d, ((0, 1), (0, 1)))[:, None], d.sum(keepdims=True).reshape(1)]


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a synthetic page."""
    blocks = blocks_of(page)
    labels = np.array([MAIN in b.text for b in blocks], np.float32)
    for b in blocks:
        b.text = b.text.replace(MAIN, "").replace(REST, "").strip() or "-"
    return features(blocks), labels


@lru_cache(maxsize=2)
def train(pages: int = PAGES, seed: int = SEED) -> Labeller:
    """Fit the labeller on seeded synthetic pages with Adam; the same seed gives the same weights."""
    source, model = Pages(seed), Labeller(seed)
    data = sorted((labelled(source.page()) for _ in range(pages)), key=lambda d: len(d[1]))
    batches = [data[k : k + BATCH] for k in range(0, len(data), BATCH)]
    first, second = [np.zeros_like(p) for p in model.p], [np.zeros_like(p) for p in model.p]
    order, step = np.random.default_rng(seed), 0
    total = PASSES * len(batches)
    for _ in range(PASSES):
        for k in order.permutation(len(batches)):
            step += 1
            rate = RATE * (1 - step / (total + 1))
            gradients = model.gradients([x for x, _ in batches[k]], [y for _, y in batches[k]])
            size = sum(float((g * g).sum()) for g in gradients) ** 0.5
            for p, g, a, b in zip(model.p, gradients, first, second, strict=True):
                g = g / max(1.0, size / 2)
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """Main text of each page: its blocks labelled as such, in page order, an empty line between them."""
    out = [""] * len(pages)
    parsed = [blocks_of(p) if p else [] for p in pages]
    order = sorted((k for k, b in enumerate(parsed) if b), key=lambda k: len(parsed[k]))

    def show(k: int, scores: np.ndarray) -> None:
        out[k] = "\n\n".join(b.text for b, main in zip(parsed[k], scores > 0, strict=True) if main)

    while order:
        longest = len(parsed[order[-1]])
        if longest > CELLS:
            show(k := order.pop(), model.long_scores(parsed[k]))
            continue
        some = order[-min(TOGETHER, CELLS // longest) :]
        del order[-len(some) :]
        for k, z in zip(some, model.scores([features(parsed[k]) for k in some]), strict=True):
            show(k, z)
    return out


def _extract(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for part in slices([batch], 4 * TOGETHER, 8 << 20, "_html"):
            texts = main_texts(part.column("_html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [part.column("_k"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["_k", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page.

    The labeller is trained once a driver process on PAGES synthetic pages (a fixed, documented sample of
    our own making) and broadcast: some 100 kB, whatever the data. Pages run together by their blocks, and a very long page in stretches. Null and empty pages, and pages without
    main blocks, give an empty text. Broken markup is read as far as it goes. Repeated rows each get a
    result; an empty table gives an empty result; other columns are not read.

    Returns: key, url, text, n_chars.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train())
    kind = pages.schema[key].dataType.simpleString()
    narrow = pages.select(F.col(key).alias("_k"), F.col(url).alias("url"), F.col(html).alias("_html"))
    out = narrow.mapInArrow(lambda it: _extract(it, shared), f"_k {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("_k", key)
