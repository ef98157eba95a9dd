"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word from both ends, labels every byte position with a
distribution over languages, and is trained in numpy by backpropagation through time. Its state
begins anew at white space (and every ``PIECE`` bytes of a longer word), so the labels of a
word's positions depend on the word alone: a task computes them once per distinct word, keeps a
bounded number of them, and gets exactly what reading the whole text would give. ASCII letters
are lower-cased and ASCII marks around a word are left out; they say nothing of the language.

A document's probabilities are pooled over all its positions: the mean log probability per
language, sharpened and normalised. Training takes at most ``SAMPLE_ROWS`` labelled texts per
language outside the held-out fold, and ``SAMPLE_WORDS`` of their words.

Texts that are null or have no letter are ``und`` with score 0; so is every text when nothing
is labelled. A text whose letters are all outside words (none such for the four scripts here)
is treated alike. Repeated rows are labelled alike, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lagline.llm import labelled
from lagline.llm.common import narrow

FOLDS, FOLD = 4, 2
SAMPLE_ROWS = 300
SAMPLE_WORDS = 24_000  # per language
LONGEST = 20_000  # longer texts are labelled, but don't teach
HIDDEN = 16
PIECE = 24
EPOCHS = 3
BATCH = 256
SHARPNESS = 4.0
VOCABULARY = 300_000  # words a task remembers
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
UNKNOWN = "und"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words without the marks around them, cut into pieces."""
    out = []
    for word in text.lower().split():
        word = word.strip(MARKS)
        if len(word) <= PIECE:
            if word:
                out.append(word)
        else:
            out.extend(word[i : i + PIECE] for i in range(0, len(word), PIECE))
    return out


def has_letter(text: bytes) -> bool:
    if text.lower() != text.upper():  # an ASCII letter
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two GRUs of ``HIDDEN`` units, one per direction, and a softmax at every byte."""

    def __init__(self, languages: list[str], seed: int = 5):
        self.languages = languages
        rng, h = np.random.default_rng(seed), HIDDEN
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p[f"u{side}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.p["v"] = rng.normal(0, 0.3, (2 * h, len(languages))).astype(np.float32)
        self.p["c"] = np.zeros(len(languages), np.float32)

    def _read(self, codes: np.ndarray, side: str, keep: bool):
        """States at every position (time, word, unit); ``keep`` also returns what training needs."""
        h, steps = HIDDEN, codes.shape[1]
        order = range(steps) if side == "f" else range(steps - 1, -1, -1)
        x, u = self.p[f"x{side}"], self.p[f"u{side}"]
        state = np.zeros((len(codes), h), np.float32)
        states, tape = np.empty((steps, len(codes), h), np.float32), []
        for t in order:
            given, s = x[codes[:, t]], state @ u
            gates = _sigmoid(given[:, : 2 * h] + s[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(given[:, 2 * h :] + r * s[:, 2 * h :])
            after = n + z * (state - n)
            if keep:
                tape.append((t, state, z, r, n, s[:, 2 * h :]))
            states[t] = state = after
        return states, tape

    def _logits(self, forward, backward):
        h = HIDDEN
        return forward @ self.p["v"][:h] + backward @ self.p["v"][h:] + self.p["c"]

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """(time, word, language) log probabilities for words of one length."""
        logits = self._logits(self._read(codes, "f", False)[0], self._read(codes, "b", False)[0])
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Mean cross entropy over all positions, and its gradients back through time."""
        h = HIDDEN
        (forward, tape_f), (backward, tape_b) = self._read(codes, "f", True), self._read(codes, "b", True)
        logits = self._logits(forward, backward)
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        count = codes.size
        rows = np.arange(len(target))
        loss = float(-np.log(prob[:, rows, target] + 1e-9).sum() / count)
        prob[:, rows, target] -= 1
        prob /= count
        flat = prob.reshape(-1, prob.shape[2])
        g = {"c": flat.sum(axis=0)}
        g["v"] = np.r_[forward.reshape(-1, h).T @ flat, backward.reshape(-1, h).T @ flat]
        for side, tape, at in (("f", tape_f, slice(0, h)), ("b", tape_b, slice(h, 2 * h))):
            u = self.p[f"u{side}"]
            g_u, carried = np.zeros_like(u), np.zeros((len(codes), h), np.float32)
            g_x = np.zeros_like(self.p[f"x{side}"])
            for t, state, z, r, n, s_n in reversed(tape):
                d = prob[t] @ self.p["v"][at].T + carried
                d_z = d * (state - n) * z * (1 - z)
                d_n = d * (1 - z) * (1 - n * n)
                d_r = d_n * s_n * r * (1 - r)
                np.add.at(g_x, codes[:, t], np.concatenate([d_z, d_r, d_n], axis=1))
                d_s = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g_u += state.T @ d_s
                carried = d * z + d_s @ u.T
            g[f"u{side}"], g[f"x{side}"] = g_u, g_x
        return g, loss

    def train(self, words: list[bytes], target: np.ndarray, seed: int = 7) -> list[float]:
        """Adam over batches of words of one length; returns the loss of each epoch."""
        rng = np.random.default_rng(seed)
        length = np.array([len(w) for w in words])
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, losses = 0, []
        by_length = {n: np.flatnonzero(length == n) for n in np.unique(length)}
        total = EPOCHS * sum(-(-len(i) // BATCH) for i in by_length.values())
        for _ in range(EPOCHS):
            batches = []
            for members in by_length.values():
                members = rng.permutation(members)
                batches += [members[i : i + BATCH] for i in range(0, len(members), BATCH)]
            seen = 0.0
            for b in rng.permutation(len(batches)):
                chosen = batches[b]
                codes = np.frombuffer(b"".join(words[i] for i in chosen), np.uint8).reshape(len(chosen), -1)
                g, loss = self.gradients(codes, target[chosen])
                seen += loss * len(chosen)
                step += 1
                rate = 0.02 * (1 - step / (total + 1)) + 0.0005
                for k, value in g.items():
                    m, v = moment[k]
                    m += 0.1 * (value - m)
                    v += 0.01 * (value * value - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            losses.append(seen / max(1, len(words)))
        return losses


class Reader:
    """Labels texts with a network, computing each distinct word once while it is remembered."""

    def __init__(self, network: Network):
        self.network = network
        self.forget()

    def forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.sums = np.zeros((1 << 12, len(self.network.languages)), np.float32)

    def _learn(self, fresh: list[bytes]) -> None:
        first = len(self.places)
        while len(self.sums) < first + len(fresh):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        by_length: dict[int, list[bytes]] = {}
        for word in fresh:
            by_length.setdefault(len(word), []).append(word)
        for words in by_length.values():
            for i in range(0, len(words), 2048):
                part = words[i : i + 2048]
                codes = np.frombuffer(b"".join(part), np.uint8).reshape(len(part), -1)
                sums = self.network.log_probabilities(codes).sum(axis=0)
                at = len(self.places)
                self.places.update(zip(part, range(at, at + len(part))))
                self.sums[at : at + len(part)] = sums

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(text, language) probabilities; rows without any word are zero."""
        words = [words_of(t) for t in texts]
        if len(self.places) > VOCABULARY:
            self.forget()
        fresh = {w for row in words for w in row if w not in self.places}
        if fresh:
            self._learn(sorted(fresh))
        out = np.zeros((len(texts), len(self.network.languages)))
        for i, row in enumerate(words):
            if row:
                at = np.fromiter(map(self.places.__getitem__, row), np.int64, len(row))
                mean = self.sums[at].sum(axis=0, dtype=np.float64) / sum(map(len, row))
                p = np.exp(SHARPNESS * (mean - mean.max()))
                out[i] = p / p.sum()
        return out


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS) -> Network | None:
    """A network trained on labelled documents outside the held-out fold; none without labels."""
    texts, _ = labelled.sample(docs, docs.where("text IS NOT NULL"), "lang", FOLDS, FOLD, rows, LONGEST)
    languages = sorted(k for k, v in texts.items() if v)
    if not languages:
        return None
    rng = np.random.default_rng(3)
    chosen, target = [], []
    for i, language in enumerate(languages):
        found = [w for t in texts[language] for w in words_of(t.encode())]
        if found:
            # As many words of each language, so that no language is likelier from the start.
            at = rng.choice(len(found), words, replace=len(found) < words)
            chosen += [found[j] for j in at]
            target += [i] * words
    network = Network(languages)
    network.train(chosen, np.array(target, dtype=np.int64))
    return network


def predictions(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        model = shared.value
        reader = Reader(model) if model else None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(1).to_pylist()
                languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if reader:
                    for i, p in enumerate(reader.pooled(texts)):
                        if p.any() and has_letter(texts[i]):
                            languages[i], scores[i] = model.languages[int(p.argmax())], float(p.max())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(languages), pa.array(scores, pa.float64())], schema=schema
                )

    rows = narrow(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", labelled.held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "lang_pred", "score")
