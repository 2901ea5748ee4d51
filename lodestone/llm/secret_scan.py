"""Secret scanning with a random forest against false positives.

Patterns find candidates in whole texts; a random forest over the candidate's
length, its character transitions, its dictionary coverage, the path and the
neighbouring words tells secrets from look-alikes. It is trained from labelled
findings. The dictionary is a short fixed list and the most frequent words of
the scanned table itself.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

# Candidate patterns by rule; the group `secret` is the candidate.
RULES = {
    "aws_key": r"(?<![0-9A-Za-z])(?P<secret>(?:AKIA|ASIA)[0-9A-Z]{16})(?![0-9A-Za-z])",
    "github_token": r"(?<![0-9A-Za-z])(?P<secret>gh[pousr]_[0-9A-Za-z]{36,})",
    "slack_token": r"(?<![0-9A-Za-z])(?P<secret>xox[abprs]-[0-9A-Za-z-]{10,})",
    "jwt": r"(?<![0-9A-Za-z])(?P<secret>eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})",
    "private_key": r"(?P<secret>-----BEGIN [A-Z ]*PRIVATE KEY-----)",
    "assignment": r"(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|credential)[\"']?[ \t]*[:=][ \t]*[\"']?(?P<secret>[^\s\"',;]{6,})",
    "hex_string": r"(?<![0-9A-Za-z])(?P<secret>[0-9a-f]{32,}+)(?![0-9A-Za-z])",
    "long_string": r"(?<![0-9A-Za-z+/_-])(?P<secret>(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[0-9A-Za-z+/_-]{24,}={0,2})",
}

# Words that placeholders are made of, and words beside harmless strings.
DICTIONARY = (
    "access account admin api auth bar change changeme client code config correct credential data default demo "
    "dev dummy empty enter env example fake field file foo function get guest hash here hidden horse insert key "
    "local login main me mock my name new none null object old param pass password path placeholder private prod "
    "public read redacted replace root sample secret server service set some staple string temp test text this "
    "todo token undefined user value variable void with word write your"
).split()
HARMLESS_WORDS = "blob build checksum commit digest etag example fingerprint guid hash id integrity md5 placeholder revision sample sha sha1 sha256 test uuid version".split()
TELLING_WORDS = "auth bearer credential credentials hmac key keys login passphrase password private secret secrets signing token".split()
TEST_PATHS = "doc docs demo example examples fixture fixtures mock readme sample spec test tests".split()

NEIGHBOUR_BUCKETS = 16
NEIGHBOUR_WORDS = 3
TREES, DEPTH = 40, 8
LABELLED_ROWS = 4000
COMMON_WORDS = 2000
LEAST_LETTERS = 4

_CLASSES = "".join("d" if chr(i).isdigit() else "u" if chr(i).isupper() else "l" if chr(i).islower() else "o" for i in range(128))
_PAIRS = {a + b: i for i, (a, b) in enumerate((a, b) for a in "dulo" for b in "dulo")}
_COMPILED = {name: re.compile(p) for name, p in RULES.items()}
_WORD = re.compile(r"[^\W\d_]{2,}")


def common_words(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The COMMON_WORDS most frequent words of LEAST_LETTERS letters or more in
    all texts, ties by the word; what comes back is bounded by that number."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(rf"(?<![\p{{L}}\p{{N}}])(\p{{L}}{{{LEAST_LETTERS},20}})(?![\p{{L}}\p{{N}}])"), F.lit(1))).alias("word"))
    return [r["word"] for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(COMMON_WORDS).collect()]


def dictionary(words: list[str] = ()) -> ahocorasick.Automaton:
    """Finds the fixed words and the given ones inside candidates."""
    found = ahocorasick.Automaton()
    for word in {*DICTIONARY, *words}:
        if len(word) > 2:
            found.add_word(word, len(word))
    found.make_automaton()
    return found


def features(secret: str, before: str, after: str, path: str, rule: str, words: ahocorasick.Automaton) -> list[float]:
    """The numbers the forest sees of one finding."""
    kinds = "".join(_CLASSES[ord(c)] if c < "\x80" else "o" for c in secret)
    moves = [0.0] * len(_PAIRS)
    for a, b in zip(kinds, kinds[1:], strict=False):
        moves[_PAIRS[a + b]] += 1 / max(1, len(secret) - 1)
    counts = np.array([secret.count(c) for c in set(secret)], dtype=float) / max(1, len(secret))
    entropy = float(-(counts * np.log2(counts)).sum()) if len(counts) else 0.0
    repeats = sum(a == b for a, b in zip(secret, secret[1:], strict=False)) / max(1, len(secret) - 1)
    steps = sum(ord(b) - ord(a) == 1 for a, b in zip(secret, secret[1:], strict=False)) / max(1, len(secret) - 1)
    covered = bytearray(len(secret))
    low = secret.lower() if secret.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in secret)
    for end, size in words.iter(low):
        covered[end + 1 - size : end + 1] = b"\x01" * size
    coverage = sum(covered) / max(1, len(secret))
    near = [w.lower() for w in _WORD.findall(before)[-NEIGHBOUR_WORDS:] + _WORD.findall(after)[:NEIGHBOUR_WORDS]]
    buckets = [0.0] * NEIGHBOUR_BUCKETS
    for w in near:
        buckets[zlib.crc32(w.encode()) % NEIGHBOUR_BUCKETS] = 1.0
    harmless = float(any(w in HARMLESS_WORDS for w in near))
    telling = float(any(w in TELLING_WORDS for w in near))
    tests = float(any(p in TEST_PATHS for p in re.split(r"[^a-z]+", path.lower())))
    named = float(bool(re.search(r"(?i)(password|passwd|pwd|token|secret|key|credential)[\"']?\s*[:=]\s*[\"']?$", before)))
    rules = [float(rule == r) for r in RULES]
    return [float(len(secret)), entropy, repeats, steps, coverage, harmless, telling, tests, named, *moves, *buckets, *rules]


def find_candidates(text: str) -> list[tuple[str, int, int]]:
    """(rule, start, end) of candidates, none over another: earlier rules win."""
    taken: list[tuple[int, int, str]] = []  # in order of their starts, so that only the neighbours can overlap
    for rule, pattern in _COMPILED.items():
        for m in pattern.finditer(text):
            a, b = m.span("secret")
            at = bisect_left(taken, (a,))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b, rule))
    return [(rule, a, b) for a, b, rule in taken]


def labelled_findings(rows: int = LABELLED_ROWS, seed: int = 11) -> list[tuple[str, str, str, str, str, int]]:
    """(candidate, before, after, path, rule, label): a seeded set of findings.
    Secrets are random draws of the known formats; look-alikes are placeholders,
    checksums, identifiers and code, as reviewers of scan results meet them."""
    rng = random.Random(seed)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    word = lambda: draw(string.ascii_lowercase, rng.randint(2, 9))
    hexa, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    names = ["password", "passwd", "token", "secret", "api_key", "access_key"]
    out = []
    for i in range(rows):
        before, after = " ".join(word() for _ in range(6)) + " ", " " + " ".join(word() for _ in range(6))
        path = rng.choice(["src", "src1", "src14", "app/settings", "deploy/env", "notes", "blog"])
        given = f"{rng.choice(names)}{rng.choice(['=', ' = ', ': '])}{rng.choice(['', chr(34)])}"
        label = i % 2
        if label:
            kind = rng.randrange(8)
            if kind == 7:
                rule, s, before = "hex_string", draw(hexa, rng.choice([32, 40, 48, 64, 128])), before + rng.choice(TELLING_WORDS) + rng.choice([" ", " is ", " of ", ", "])
            elif kind == 0:
                rule, s = "aws_key", "AKIA" + draw(upper, 16)
            elif kind == 1:
                rule, s = "github_token", "ghp_" + draw(alnum, 36)
            elif kind == 2:
                rule, s = "slack_token", "xoxb-" + draw(string.digits, 11) + "-" + draw(alnum, 24)
            elif kind == 3:
                rule, s = "jwt", "eyJ" + draw(alnum, 17) + ".eyJ" + draw(alnum, 40) + "." + draw(alnum, 43)
            elif kind == 4:
                rule, s, before = "assignment", draw(hexa, rng.choice([16, 18, 20, 32, 40, 64])), before + given
            elif kind == 5:
                rule, s, before = "assignment", draw(alnum + "!@#%_-", rng.randint(10, 40)), before + given
            else:
                rule, s = rng.choice([("private_key", "-----BEGIN RSA PRIVATE KEY-----"), ("long_string", draw(alnum, rng.randint(32, 48)))])
        else:
            kind = rng.randrange(7)
            if kind == 0:
                rule, s, before = "assignment", rng.choice(["_", "-", ""]).join(rng.sample(DICTIONARY, 3)), before + given
            elif kind == 1:
                rule, s, before = "assignment", rng.choice("x*.0-") * rng.randint(6, 24), before + given
            elif kind == 2:
                rule, s, before = "hex_string", draw(hexa, rng.choice([32, 40, 64])), before + rng.choice(HARMLESS_WORDS) + " "
            elif kind == 3:
                rule, s, before = "assignment", rng.choice(["os.environ[", "getenv(", "config.", "self.", "${", "<"]) + word() + rng.choice(["", ")", "}", ">", "]"]), before + given
            elif kind == 4:
                rule, s = "aws_key", "AKIA" + rng.choice(["IOSFODNN7EXAMPLE", "X" * 16, "0123456789ABCDEF", "EXAMPLEEXAMPLE12"])
            elif kind == 5:
                rule, s, path = "assignment", rng.choice(["password", "secret", "test", "changeme", "example", "dummy"]) + rng.choice(["", "1", "123", "1234", "!"]), rng.choice(["tests/unit", "docs/readme", "examples"])
                s, before = s.ljust(6, "1"), before + given
            else:
                rule, s = rng.choice([("long_string", "".join(word().title() for _ in range(6)) + "1"), ("hex_string", rng.choice(hexa) * 40), ("github_token", "ghp_" + "x" * 36)])
        out.append((s, before, after, path, rule, label))
    return out


def train_forest(spark: SparkSession, findings=None, words: list[str] = (), seed: int = 11) -> RandomForestClassificationModel:
    """Fit the forest to labelled findings, LABELLED_ROWS of them by default,
    under the dictionary that the scan will use."""
    known = dictionary(words)
    rows = [(float(x[5]), [float(v) for v in features(*x[:5], known)]) for x in (findings or labelled_findings())]
    data = spark.createDataFrame(rows, "label double, numbers array<double>").select("label", array_to_vector("numbers").alias("features")).coalesce(2)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(data)


def scan_secrets(docs: DataFrame, forest: RandomForestClassificationModel, words: list[str] = (), id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, rule, start, length, secret_sha256,
    probability and is_secret, at `threshold`. The secret itself isn't returned.

    Positions count code points from 0. Defined cases: null and empty texts
    have no candidates; a null path is an empty one; equal candidates at
    different places are different findings, as are those of repeated rows;
    null ids keep their findings, and ids of any type keep it; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = dictionary(words)
        for batch in batches:
            out = []
            for doc_id, text, path in zip(batch["doc_id"], batch["text"], batch["path"], strict=True):
                if not isinstance(text, str):
                    continue
                for rule, a, b in find_candidates(text):
                    s = text[a:b]
                    numbers = features(s, text[max(0, a - 80) : a], text[b : b + 80], path or "", rule, known)
                    out.append((doc_id, rule, a, b - a, hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest(), numbers))
            yield pd.DataFrame(out, columns=["doc_id", "rule", "start", "length", "secret_sha256", "numbers"])

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.col(path_col).alias("path"))
    found = rows.mapInPandas(scan, "doc_id string, rule string, start long, length long, secret_sha256 string, numbers array<double>")
    judged = forest.transform(found.withColumn("features", array_to_vector("numbers")))
    chance = vector_to_array("probability")[1]
    return judged.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "rule", "start", "length", "secret_sha256", chance.alias("probability"), (chance >= threshold).alias("is_secret"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = common_words(docs)
    return scan_secrets(docs, train_forest(spark, words=words), words)
