"""Secret scan: fixed patterns, and a character convolutional network over every candidate.

Patterns (leftmost, not overlapping, per kind; offsets in code points): assignments of long values to telling names,
access key ids, long hexadecimal runs. Their spans always stay. A candidate is any run of LEAST or more key-like signs,
whatever it is made of, those that patterns name among them; the network sees windows over the whole run with the text
around it, and the run's score is that of its highest window. A run that scores is a span of its own unless a pattern's
span covers it.

The network is trained here, in numpy, on labelled findings of two kinds: the candidates of all texts, labelled by the
patterns, and made ones of shapes that no pattern
names (secrets of many services against mail addresses, links, identifiers, dates and prose). It learns from made findings
first; then findings of the texts, dealt by hash into buckets of about BUCKET, train a copy each, together with the made
ones, and the mean of the copies is the network. Findings go by document to
training, to calibration or to the figures, never to two of them. Findings of the texts are many more than made ones: each
counts, but those of one kind weigh at most as much as MOST. Scores are calibrated; the threshold is the highest one
that keeps RECALL of the secrets set aside for it; ``trained`` tells recall and precision on the third part, found end to
end, from the texts through candidates to spans.

Defined cases: null and empty texts have no spans; texts of any length are scanned whole; repeated rows are scanned one by
one; a null doc_id stays null; equal findings (ties) label once; other columns, whatever their names, are
ignored; an empty table gives no rows (the network then learns from made findings alone).
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from copy import deepcopy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import dropped, stored

KINDS = ("assign", "access", "hex", "model")
NAME = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = re.compile(NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LEAST)
#: About how many windows a copy of the network learns from, and how much the findings of texts of one kind weigh at most.
BUCKET, MOST = 16384, 2000
TRAINING, CALIBRATION, FIGURES = 0, 1, 2
#: Logits are counted in steps of one part in so many.
STEPS = 256
SPAN, BEFORE, AFTER = 40, 20, 8
LENGTH = BEFORE + SPAN + AFTER
FILTERS, WIDTH, DIM = 24, 5, 8
RECALL = 0.99
CODES = np.zeros(0x110000, np.uint8)
CODES[32:127] = np.arange(1, 96)
CODES[[9, 10, 13]] = 96
CODES[128:] = 97


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def labelled(text: str) -> list[tuple[int, int, bool]]:
    """Candidates of a text, and whether a pattern finds a secret in them."""
    known = [(m.start(1), m.end(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    known += [(s, e) for s, k, e in base_spans(text) if k]
    return [(a, b, any(s < b and a < e for s, e in known)) for a, b in candidates(text)]


def windows(text: str, a: int, b: int) -> list[np.ndarray]:
    """Codes of the run with its surroundings, in overlapping windows if the run is long."""
    out = []
    for s in range(a, max(a + 1, b - SPAN // 2), SPAN // 2) if b - a > SPAN else (a,):
        e = min(b, s + SPAN)
        left, right = text[max(0, s - BEFORE) : s], text[e : e + AFTER]
        x = np.zeros(LENGTH, np.uint8)
        x[BEFORE - len(left) : BEFORE] = CODES[np.frombuffer(left.encode("utf-32-le", "replace"), np.uint32)]
        x[BEFORE : BEFORE + e - s] = CODES[np.frombuffer(text[s:e].encode("utf-32-le", "replace"), np.uint32)]
        x[BEFORE + SPAN : BEFORE + SPAN + len(right)] = CODES[np.frombuffer(right.encode("utf-32-le", "replace"), np.uint32)]
        out.append(x)
    return out


class Net:
    """Embedding, one convolution, ReLU, maximum and mean over positions, logistic output; calibrated."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {"emb": r.normal(0, 0.5, (98, DIM)), "w": r.normal(0, 0.2, (WIDTH * DIM, FILTERS)), "b": np.zeros(FILTERS), "v": r.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1)}
        self.a, self.z, self.cut = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray) -> tuple:
        e = self.p["emb"][x]
        n = LENGTH - WIDTH + 1
        cols = np.concatenate([e[:, j : j + n] for j in range(WIDTH)], 2)
        h = np.maximum(cols @ self.p["w"] + self.p["b"], 0)
        top = h.argmax(1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], 1)
        return pooled @ self.p["v"] + self.p["c"][0], (cols, h, top, pooled, n)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 256])[0] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.004, seed: int = 4, weight: np.ndarray | None = None) -> None:
        weight = np.ones(len(x)) if weight is None else weight
        r, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 64):
                b = order[i : i + 64]
                z, (cols, h, top, pooled, n) = self.forward(x[b])
                d = (1 / (1 + np.exp(-z)) - y[b]) * weight[b] / len(b)
                g = {"v": pooled.T @ d, "c": np.array([d.sum()])}
                up = d[:, None] * self.p["v"][None]
                dh = np.repeat(up[:, None, FILTERS:] / n, n, 1)
                k, f = np.meshgrid(np.arange(len(b)), np.arange(FILTERS), indexing="ij")
                dh[k, top, f] += up[:, :FILTERS]
                dh *= h > 0
                g["w"], g["b"] = np.einsum("bnc,bnf->cf", cols, dh), dh.sum((0, 1))
                dc = dh @ self.p["w"].T
                g["emb"] = np.zeros_like(self.p["emb"])
                for j in range(WIDTH):
                    np.add.at(g["emb"], x[b][:, j : j + n], dc[:, :, j * DIM : (j + 1) * DIM])
                t += 1
                for q in g:
                    m[q] = 0.9 * m.get(q, 0) + 0.1 * g[q]
                    v[q] = 0.999 * v.get(q, 0) + 0.001 * g[q] ** 2
                    self.p[q] -= rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Platt scaling on logits of runs, then the highest threshold that keeps RECALL of the secrets."""
        share = weight / weight.sum()
        for _ in range(500):
            d = share * (1 / (1 + np.exp(-(self.a * z + self.z))) - y)
            self.a -= 0.05 * float((d * z).sum())
            self.z -= 0.05 * float(d.sum())
        p = self.calibrated(z[y > 0])
        order = np.argsort(p)
        heavy = np.cumsum(weight[y > 0][order])
        self.cut = float(p[order][np.searchsorted(heavy, (1 - RECALL) * heavy[-1], "right")])

    def highest(self, runs: list[list[np.ndarray]], score) -> np.ndarray:
        """The highest score of each run's windows."""
        at = np.cumsum([0, *map(len, runs)])[:-1]
        return np.maximum.reduceat(score(np.array([w for r in runs for w in r])), at) if len(runs) else np.zeros(0)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * z + self.z)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))


def findings(n: int, seed: int) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """Made findings: the windows of each run, and labels."""
    r = random.Random(seed)
    words = [a + b for a in ("the", "an", "re", "tion", "que", "ser", "ment", "con", "log", "val", "user", "data") for b in ("er", "ing", "ado", "le", "is", "base", "name", "list", "ed", "us")]
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    good = [
        lambda: pick(low + up + dig, r.randint(20, 64)),
        lambda: pick(low + up + dig + "+/", 4 * r.randint(6, 16)) + r.choice(("", "=", "==")),
        lambda: "ghp_" + pick(low + up + dig, 36),
        lambda: "sk-" + pick(low + up + dig, r.randint(24, 48)),
        lambda: "xoxb-" + pick(dig, 11) + "-" + pick(low + up + dig, 24),
        lambda: "AIza" + pick(low + up + dig + "_-", 35),
        lambda: "eyJ" + pick(low + up + dig + "_-", r.randint(40, 90)),
        lambda: pick(up + dig, r.randint(20, 40)),
        lambda: pick(low + dig, r.randint(24, 40)),
        lambda: pick("0123456789ABCDEF", r.choice((32, 40, 64))),
    ]
    bad = [
        lambda: r.choice(("_", "-")).join(r.choice(words) for _ in range(r.randint(3, 6))) + str(r.randint(1, 99)),
        lambda: "".join(r.choice(words).capitalize() for _ in range(r.randint(3, 6))),
        lambda: r.choice(words) + "".join(r.choice(words).capitalize() for _ in range(r.randint(2, 4))),
        lambda: "/".join(r.choice(words) for _ in range(r.randint(3, 5))) + f"/{r.randint(1, 2030)}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(10, 23)}",
        lambda: "-".join(pick(dig, k) for k in r.choice(((4, 4, 4, 4), (3, 3, 4, 4), (5, 6, 5)))),
        lambda: "".join(r.choice(words) for _ in range(r.randint(3, 7))) + str(r.randint(0, 9999)),
        lambda: "".join(r.choice(words) for _ in range(r.randint(3, 6))).upper(),
        lambda: "=" * r.randint(8, 40) + pick(dig, 1) + "-" * r.randint(8, 20),
        lambda: "#".replace("#", "/") + "/".join(pick(low, r.randint(4, 8)) for _ in range(3)) + "/v" + pick(dig, 1),
        lambda: r.choice("abxyz") * r.randint(16, 40) + pick(dig, 1),
    ]
    runs, y = [], []
    for i in range(n):
        t = r.choice(good if i % 2 else bad)()
        name = r.choice(("key: ", "auth ", "bearer ", "id=", "credential ", "private_key = '", "", "")) if i % 2 or r.random() < 0.15 else ""
        left = prose(r.randint(0, 6)) + r.choice((" ", "\n", ". ")) + name
        text = left + t + r.choice((" ", "'", ".", ",", "\n", "")) + prose(2)
        # The run is cut out as in a text: signs that touch it belong to it.
        for a, b in candidates(text):
            if a < len(left) + len(t) and len(left) < b:
                runs.append(windows(text, a, b))
                y.append(i % 2)
    return runs, np.array(y, float)


def part_of(docs: DataFrame, part: int) -> DataFrame:
    """The texts of a part: training (half the documents), calibration, figures."""
    at = F.pmod(F.shiftright(F.xxhash64(F.lit(8), "doc_id", "text"), 41), F.lit(4))
    return docs.filter(F.greatest(at - 1, F.lit(0)) == part).select("text")


def evened(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of findings of texts, each of which stands for n: no kind weighs more than MOST."""
    out = n.astype(float)
    for kind in (0, 1):
        out[y == kind] *= min(1.0, MOST / max(1.0, float(n[y == kind].sum())))
    return out


def learnt(docs: DataFrame, net: Net, made: tuple[list[list[np.ndarray]], np.ndarray]) -> tuple[Net, int]:
    """The network after all findings of the training part, and how many windows they have (equal ones once)."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = {(secret, w.tobytes()) for t in batch.column(0).slice(at, 500).to_pylist() for a, b, secret in labelled(t or "") for w in windows(t, a, b)}
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.binary())], ["secret", "seen"])

    found = stored(part_of(docs, TRAINING).mapInArrow(label, "secret boolean, seen binary").distinct(), "findings")
    n = found.count()
    if not n:
        return net, 0
    more = np.array([w for r in made[0] for w in r])
    kinds = np.repeat(made[1], list(map(len, made[0])))

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seen", "secret"])
        y = rows.secret.to_numpy().astype(float)
        own = np.frombuffer(b"".join(rows.seen), np.uint8).reshape(-1, LENGTH)
        copy = deepcopy(net)
        copy.train(np.concatenate([more, own]), np.concatenate([kinds, y]), epochs=1, weight=np.concatenate([np.ones(len(more)), evened(y, np.ones(len(y)))]))
        return pd.DataFrame({"bucket": [int(rows.bucket.iloc[0])], "n": [len(rows)], "net": [b"".join(copy.p[k].astype("<f8").tobytes() for k in sorted(copy.p))]})

    buckets = -(-n // BUCKET)
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("seen"), F.lit(buckets)).cast("int"))
    copies = sorted(dealt.groupBy("bucket").applyInPandas(train, "bucket int, n long, net binary").collect())
    dropped(found)
    mean = sum(np.frombuffer(r["net"], "<f8") * (r["n"] / n) for r in copies)
    out, at = deepcopy(net), 0
    for k in sorted(net.p):
        out.p[k] = mean[at : at + net.p[k].size].reshape(net.p[k].shape)
        at += net.p[k].size
    return out, n


def counted(docs: DataFrame, net: Net, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of all findings of a part (equal ones once), in steps rounded down, their labels, and how many have them."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                runs = {}
                for t in batch.column(0).slice(at, 500).to_pylist():
                    for a, b, secret in labelled(t or ""):
                        w = windows(t, a, b)
                        runs[hashlib.blake2b(b"".join(x.tobytes() for x in w), digest_size=16).digest(), secret] = w
                if runs:
                    z = np.floor(net.highest(list(runs.values()), net.logits) * STEPS).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in runs], pa.binary()), pa.array([k[1] for k in runs], pa.bool_()), pa.array(z)], ["seen", "secret", "z"])

    found = part_of(docs, part).mapInArrow(score, "seen binary, secret boolean, z long")
    rows = found.groupBy("seen", "secret").agg(F.min("z").alias("z")).groupBy("secret", "z").agg(F.count("*").alias("n")).collect()
    rows = np.array(sorted((r.z, int(r.secret), r.n) for r in rows), np.int64).reshape(-1, 3)
    return rows[:, 0] / STEPS, rows[:, 1].astype(float), rows[:, 2]


def trained(docs: DataFrame | None = None, tell: bool = True) -> tuple[Net, dict[str, float]]:
    """The network, and (unless told not to tell) its recall and precision on findings it never saw, of the texts (if any)
    and made."""
    made = [findings(n, seed) for n, seed in ((4000, 1), (2000, 2), (2000, 3))]
    net, figures, own = Net(), {}, (np.zeros(0), np.zeros(0), np.zeros(0))
    runs, y = made[0]
    net.train(np.array([w for r in runs for w in r]), np.repeat(y, list(map(len, runs))))
    if docs is not None:
        net, figures["texts_learnt"] = learnt(docs, net, made[0])
        own = counted(docs, net, CALIBRATION)
    runs, y = made[1]
    net.calibrate(np.concatenate([net.highest(runs, net.logits), own[0]]), np.concatenate([y, own[1]]), np.concatenate([np.ones(len(y)), evened(own[1], own[2])]))
    if not tell:
        return net, figures
    runs, y = made[2]
    for name, (z, y, n) in (("made", (net.highest(runs, net.logits), y, np.ones(len(y)))), ("texts", counted(docs, net, FIGURES) if docs is not None else own)):
        hit = net.calibrated(z) >= net.cut
        figures |= {f"{name}_secrets": float(n[y > 0].sum()), f"{name}_others": float(n[y == 0].sum()), f"{name}_found": float(n[hit & (y > 0)].sum()), f"{name}_false": float(n[hit & (y == 0)].sum())}
    return net, figures


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts by kind, a digest of the pattern spans, all spans as kind:start:end."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    net, _ = trained(docs, tell=False)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more: list[list] = [[] for _ in texts]
                owner, x = [], []
                for i, t in enumerate(texts):
                    for a, b in candidates(t):
                        for w in windows(t, a, b):
                            owner.append((i, a, b))
                            x.append(w)
                if x:
                    p = model.scores(np.array(x))
                    best: dict[tuple, float] = {}
                    for o, v in zip(owner, p.tolist(), strict=True):
                        best[o] = max(v, best.get(o, 0.0))
                    for (i, a, b), v in best.items():
                        if v >= model.cut and not any(s <= a and b <= e for s, _, e in base[i]):
                            more[i].append((a, 3, b))
                n = [[sum(k == j for _, k, _ in b) for b in base] for j in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(v, pa.int64()) for v in n), pa.array([len(m) for m in more], pa.int64()), pa.array([hashlib.sha256(say(b).encode()).hexdigest() for b in base]), pa.array([say(sorted(b + m)) for b, m in zip(base, more, strict=True)])],
                    ["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"],
                )

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")
