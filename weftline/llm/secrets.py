"""Secret scan with a random forest that removes false positives.

Candidates are long runs of key characters that hold a digit or begin like a known key, and whatever is assigned to a name
such as password or token.  Each becomes a row of features: length, shares and transitions of
character classes, entropy, improbable letter pairs, how much of it dictionary words cover, the kind
of path it stands in, and telling words beside it.  A forest trained on labelled findings
decides.  Labelled findings are given as a table, of which a bounded sample is used, or come
from ``examples``: invented findings of known kinds, the same ones each time.

Edge cases: null and empty texts have no candidates; texts and candidates of any length are
scanned and measured whole; a null path is an empty one; of candidates that overlap, the one that
begins first counts, of those that begin together the longer; equal candidates are reported
where they stand; a probability of just the threshold is a secret; one row in, one row out,
repeated rows included, and an empty table gives none; without labelled findings nothing is a
secret; columns other than doc_id, text and the path are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import blocks, spread, table

BLOCK = 4 << 20
#: Labelled findings learned from, at most.
MOST_LABELLED = 8_000
#: Characters beside a candidate that are looked at.
BESIDE = 40

RUN = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
ASSIGNED = re.compile(r"(?i)(?:passw(?:or)?d|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth)[\"']?\s*[=:]\s*[\"']?([^\s\"',;<>]{6,})")
DIGIT = re.compile(r"[0-9]")
#: Beginnings of keys of known issuers (fixed values).
KNOWN = re.compile(r"AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|sk-|AIza|eyJ")

#: Words that speak for and against a secret, and parts of paths (fixed values).
FOR = frozenset("password passwd pwd secret token key apikey api auth bearer credential credentials private access aws login".split())
AGAINST = frozenset("commit sha sha1 sha256 md5 checksum hash digest uuid guid id version revision isbn phone tel card order invoice serial build date".split())
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "your", "placeholder", "xxxx", "test", "foobar", "todo", "1234", "abcd", "0000", "redacted")
HARMLESS_PATHS = ("test", "example", "fixture", "mock", "doc", "readme", "sample", "lock", "vendor")
#: Common words for coverage (fixed values).
DICTIONARY = frozenset(
    "the and for that with this have from they will would there their what about which when make like time just know take people into year your"
    " good some could them other than then look only come over think also back after use two how our work first well way even new want because any"
    " these give day most data file name user list value type class function return config server client path image style page content update"
    " index table query string number object array build release version account service system".split()
)

FEATURES = (
    "length", "lower", "upper", "digit", "sign", "hexadecimal", "class_changes", "case_changes", "entropy", "entropy_of_length", "rare_pairs",
    "dictionary", "longest_letters", "longest_digits", "distinct", "placeholder", "for_near", "for_far", "against", "quoted", "assigned", "path", "prefix", "padding", "dashes",
)

_COMMON_PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split())


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans, in order, each once."""
    if not text:
        return []
    found = {m.span() for m in RUN.finditer(text) if DIGIT.search(m[0]) or KNOWN.match(m[0])}
    found.update(m.span(1) for m in ASSIGNED.finditer(text))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(left: str, said: str, right: str, path: str) -> list[float]:
    """One row for the forest."""
    n = max(1, len(said))
    kinds = [_kind(c) for c in said]
    share = [kinds.count(k) / n for k in range(4)]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / n
    cases = sum({a, b} == {0, 1} for a, b in zip(kinds, kinds[1:])) / n
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(said).values())
    low = said.lower()
    pairs = [low[i : i + 2] for i in range(n - 1) if low[i : i + 2].isalpha()]
    rare = sum(p not in _COMMON_PAIRS for p in pairs) / max(1, len(pairs)) if pairs else 0.5
    covered = sum(len(w) for w in re.findall(r"[a-z]{3,}", low) if w in DICTIONARY) / n
    words = [w.lower() for w in re.findall(r"[A-Za-z]+[0-9]*", left[-BESIDE:])]
    near, far = words[-1:], words[-4:]
    return [
        n, *share, sum(c in "0123456789abcdefABCDEF" for c in said) / n, changes, cases, entropy, entropy / math.log2(n + 1), rare,
        covered, max(map(len, re.findall(r"[A-Za-z]*", said))), max(map(len, re.findall(r"[0-9]*", said))), len(set(said)) / n,
        float(any(p in low for p in PLACEHOLDERS)), float(any(w in FOR for w in near)), float(sum(w in FOR for w in far)), float(sum(w in AGAINST for w in far)),
        float(left[-1:] in "\"'" and left != ""), float(bool(re.search(r"[=:]\s*[\"']?$", left))), float(any(p in path.lower() for p in HARMLESS_PATHS)),
        float(bool(KNOWN.match(said))), float(said.endswith("=")), said.count("-") / n,
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in leaves), threshold, left and right child, share of secrets."""

    trees: list[tuple[np.ndarray, ...]]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for feature, threshold, left, right, share in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            while True:
                f = feature[node]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = np.where(rows[inner, f[inner]] <= threshold[at], left[at], right[at])
            out += share[node]
        return out / max(1, len(self.trees))


def train(rows: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, bins: int = 32, seed: int = 11) -> Forest:
    """Bagged trees on the square root of the features at each node, split by Gini impurity."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    tried = max(1, round(math.sqrt(rows.shape[1])))
    out = []
    for _ in range(trees):
        feature, threshold, left, right, share = [], [], [], [], []

        def grow(own: np.ndarray, level: int) -> int:
            node = len(feature)
            for c, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (share, float(y[own].mean()))):
                c.append(v)
            if level == depth or len(own) < 2 * least or share[node] in (0.0, 1.0):
                return node
            best = (1e-9, -1, 0)
            base = share[node] * (1 - share[node])
            for f in rng.choice(rows.shape[1], tried, replace=False):
                n = np.cumsum(np.bincount(binned[own, f], minlength=len(edges[f]) + 1))[:-1]
                s = np.cumsum(np.bincount(binned[own, f], weights=y[own], minlength=len(edges[f]) + 1))[:-1]
                ok = (n >= least) & (len(own) - n >= least)
                if not ok.any():
                    continue
                p, q = s / np.maximum(n, 1), (y[own].sum() - s) / np.maximum(len(own) - n, 1)
                gain = np.where(ok, base - (n * p * (1 - p) + (len(own) - n) * q * (1 - q)) / len(own), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], int(f), k)
            if best[1] < 0:
                return node
            feature[node], threshold[node] = best[1], float(edges[best[1]][best[2]])
            low = binned[own, best[1]] <= best[2]
            left[node] = grow(own[low], level + 1)
            right[node] = grow(own[~low], level + 1)
            return node

        grow(rng.integers(0, len(rows), len(rows)), 0)
        out.append((np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(share)))
    return Forest(out)


def examples(n: int = 6000, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Invented labelled findings ``(left, candidate, right, path, label)``."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    syllables = "an er in on re th ti en at es or nd st ou le de la ie ung che que oi ar os".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 6))) + " "
    name = lambda: rng.choice(["token", "api_key", "secret", "auth_token", "access_key", "password"])
    eq = lambda: rng.choice(["=", " = ", ": ", " : "]) + rng.choice(["", '"', "'"])
    yes = [
        lambda: (prose(), "AKIA" + pick(upper, 16)),
        lambda: (prose() + name() + eq(), "AKIA" + pick(upper, 16)),
        lambda: (prose() + name() + eq(), pick(hexa, rng.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: (prose() + "password" + eq(), pick(alnum + "-_", rng.randint(10, 24))),
        lambda: (prose() + "password=", pick(hexa, rng.randint(12, 20))),
        lambda: (prose() + 'token = "', pick(hexa, 40)),
        lambda: (prose(), "ghp_" + pick(alnum, 36)),
        lambda: (prose() + "Bearer ", "eyJ" + pick(alnum, rng.randint(30, 120))),
        lambda: (prose() + name() + eq(), pick(alnum + "+/", rng.choice([22, 40, 43, 86])) + rng.choice(["", "=", "=="])),
    ]
    no = [
        lambda: (prose(), pick("0123456789", rng.choice([12, 13, 14, 15, 16, 16, 16, 19]))),
        lambda: (prose() + rng.choice(["card ", "order ", "tel ", "id ", "invoice ", "isbn "]), pick("0123456789", rng.randint(12, 18))),
        lambda: (prose() + rng.choice(["commit ", "sha1 ", "md5: ", "checksum ", "sha256:", "revision ", "hash "]), pick(hexa, rng.choice([32, 40, 64]))),
        lambda: (prose() + rng.choice(["uuid ", "id=", "guid: ", "id "]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: (prose(), "/".join(word() for _ in range(4)) + str(rng.randint(1, 999))),
        lambda: (prose(), "-".join(word() for _ in range(4)) + "-" + str(rng.randint(1, 99))),
        lambda: (prose(), "_".join(word() for _ in range(3)) + f"_{rng.randint(1, 99)}"),
        lambda: (prose(), word() + word() + word() + word() + str(rng.randint(1, 9))),
        lambda: (prose() + name() + eq(), rng.choice(["your_token_here_1", "changeme123456", "example-key-0001", "xxxxxxxxxxxx1234", "test1234test1234", "placeholder_00", "dummy-secret-123"])),
        lambda: (prose() + rng.choice(["password: ", "token: ", "secret = ", "auth: "]), rng.choice([word() + word() + word(), "none", "required", "os.environ", "config.get(name)", "getpass()"])),
        lambda: (prose() + "version ", f"release-{rng.randint(1, 9)}-{rng.randint(10, 99)}-{rng.randint(2000, 2030)}"),
        lambda: (prose(), f"20{rng.randint(10, 30)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}"),
    ]
    out = []
    for _ in range(n):
        label = int(rng.random() < 0.45)
        left, said = rng.choice(yes if label else no)()
        path = rng.choice(["src/app", "web", "", "", "", "", "crawl", "feed7", "deploy/prod"])
        if label and rng.random() < 0.04:
            path, label = rng.choice(["tests/fixtures/a", "docs/example"]), 0
        out.append((left, said, rng.choice(['"', " ", "' ", "\n"]) + prose(), path, label))
    return out


def learn(findings: DataFrame | None = None, most: int = MOST_LABELLED) -> Forest:
    """From labelled findings ``(left_text, candidate, right_text, path, label)``, or from the invented ones."""
    if findings is None:
        rows = examples()
    else:
        known = findings.where("candidate is not null and label is not null").orderBy(F.xxhash64("candidate", "left_text"), "candidate", "left_text").limit(most)
        rows = [tuple(r) for r in known.select("left_text", "candidate", "right_text", "path", "label").collect()]
    if not rows:
        return Forest([])
    x = np.array([features(a or "", c, b or "", p or "") for a, c, b, p, _ in rows])
    return train(x, np.array([float(r[4]) for r in rows]))


def scan_text(text: str, path: str, forest: Forest) -> list[tuple[int, int, float]]:
    """``(start, end, probability)`` of every candidate."""
    spans = candidates(text)
    if not spans:
        return []
    x = np.array([features(text[max(0, a - BESIDE) : a], text[a:b], text[b : b + BESIDE], path) for a, b in spans])
    return [(a, b, float(p)) for (a, b), p in zip(spans, forest.probability(x))]


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """``(doc_id, n_candidates, n_secrets, secrets)``; secrets are ``(start, end, probability)`` in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text", BLOCK):
                got = [scan_text(t or "", p or "", shared.value) for t, p in zip(b.column("text").to_pylist(), b.column("path").to_pylist())]
                kept = [[{"start": x, "end": y, "probability": p} for x, y, p in g if p >= threshold] for g in got]
                digest = [hashlib.sha256("\n".join((t or "")[s["start"] : s["end"]] for s in k).encode()).hexdigest() for t, k in zip(b.column("text").to_pylist(), kept)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, got), pa.int64()), pa.array(map(len, kept), pa.int64()), pa.array(digest, pa.string()), pa.array(kept, kind)], names=["doc_id", "n_candidates", "n_secrets", "secrets_sha256", "secrets"])

    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", where.alias("path")).mapInArrow(run, f"doc_id {id_kind}, n_candidates bigint, n_secrets bigint, secrets_sha256 string, secrets array<struct<start:bigint,end:bigint,probability:double>>")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, and the digest of their texts in order, one a line."""
    return scan(spread(table(spark, sf_dir, "documents")), learn()).drop("secrets")


QUERIES = {"op5_secrets": op5_secrets}
ORACLE_SQL: dict[str, str] = {}
