"""Secret scan: patterns for known kinds, and a token-efficiency test for the rest.

Ordinary text costs a byte-pair vocabulary few tokens for its length; random
strings cost many.  Runs of key characters with a low number of characters per
token are reported as kind ``random``, unless they are digests of a known length,
UUIDs or plain numbers.  Of a run that is ordinary as a whole, the stretches between
separators are tested, so that words beside a key cannot hide it.

Null and empty texts have no spans.  Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from functools import cache

import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import only, original, split, with_columns

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: Each assignment starts with one of these, whatever the case.
KEYWORDS = re.compile("passw|secret|token|api", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Strings this long or longer are tested.  Up to ``SURE`` characters, and in stretches of several parts, a key also
#: mixes lower case, capitals after the first character, and digits, two of the three at least: of the alphanumeric
#: words of 10,000 documents (`sf0.1`), 38 of 16 to 19 characters have a low ratio, all plain letters; 26 of 15, 363 of 14.
MIN_RUN, SURE = 16, 20
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}")
PART = re.compile(r"[A-Za-z0-9]+")
#: What base spans leave of a random run is reported from this length on.
MIN_REST = 8
#: Characters per token at or below which a run counts as random.
MAX_RATIO = 2.0
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
NUMBER = re.compile(r"[0-9_+/-]+\Z")
INNER_UUID = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern[:-2]}(?![A-Za-z0-9])")
#: Longest piece given to the tokenizer at once; longer runs are tested piece by piece.
PIECE = 4096


@cache
def vocabulary(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: per kind leftmost without overlap, too short ones dropped."""
    found = []
    if KEYWORDS.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known_identifier(run: str) -> bool:
    """Digests, UUIDs and numbers are random strings that need no hiding."""
    return bool(len(run) in DIGEST_LENGTHS and DIGEST.match(run) or UUID.match(run) or NUMBER.match(run))


def chars_per_token(run: str, encoding: tiktoken.Encoding) -> float:
    tokens = sum(len(encoding.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))
    return len(run) / tokens


def mixed(run: str) -> bool:
    """Whether lower case, capitals after the first character, and digits are there, two of the three at least."""
    return bool(re.search("[a-z]", run)) + bool(re.search("[A-Z]", run[1:])) + bool(re.search("[0-9]", run)) >= 2


def is_random(run: str, encoding: tiktoken.Encoding) -> bool:
    if len(run) < MIN_RUN or known_identifier(run) or len(run) < SURE and not mixed(run):
        return False
    return chars_per_token(run, encoding) <= MAX_RATIO


def random_stretches(run: str, encoding: tiktoken.Encoding) -> list[tuple[int, int]]:
    """Stretches from part to part (between separators) whose ratio is low: the maximal ones by tokens above the ratio.

    A part scores ``MAX_RATIO`` times its tokens less its characters; numbers score nothing, identifiers part what
    stands around them.  All maximal scoring stretches are found in one pass (Ruzzo and Tompa).
    """
    uuids = [m.span() for m in INNER_UUID.finditer(run)] if "-" in run else []
    found: list[tuple[int, int]] = []
    held: list[tuple[int, int, float, float]] = []  # start, end, score before, score after
    total, u = 0.0, 0
    for m in PART.finditer(run):
        while u < len(uuids) and uuids[u][1] <= m.start():
            u += 1
        if u < len(uuids) and uuids[u][0] <= m.start() or len(m[0]) in DIGEST_LENGTHS and DIGEST.match(m[0]):
            found += [(s, e) for s, e, *_ in held]
            held = []
            continue
        before = total
        total += 0 if m[0].isdigit() else MAX_RATIO * len(m[0]) / chars_per_token(m[0], encoding) - len(m[0])
        if total <= before:
            continue
        start, end, low, high = m.start(), m.end(), before, total
        # joins the nearest stretch that began lower, if the sum has grown since that one ended
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j -= 1
            if j < 0 or held[j][3] >= high:
                break
            start, low = held[j][0], held[j][2]
            del held[j:]
        # those that began no lower can join nothing any more
        found += [(a, b) for a, b, *_ in held[j + 1 :]]
        del held[j + 1 :]
        held.append((start, end, low, high))
    found += [(s, e) for s, e, *_ in held]
    # a window of one part is judged like a run; several parts need mixed characters whatever their length
    out = []
    for s, e in found:
        window = run[s:e]
        several = PART.fullmatch(window) is None
        if len(window) >= (SURE if several else MIN_RUN) and not known_identifier(window) and (mixed(window) or not several and len(window) >= SURE):
            out.append((s, e))
    return sorted(out)


def uncovered(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What disjoint spans in order leave of a range."""
    out = []
    for s, e in taken[max(0, bisect_right(taken, (start,)) - 1) :]:
        if s >= end:
            break
        if start < s:
            out.append((start, s))
        start = max(start, e)
    return [*out, (start, end)] if start < end else out


def random_spans(text: str, taken: list[tuple[int, int, int]], encoding: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    """Runs and stretches of runs with few characters per token, without what base spans cover."""
    covered: list[tuple[int, int]] = []
    for s, _, e in sorted(taken):
        if covered and s <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(e, covered[-1][1]))
        else:
            covered.append((s, e))
    out = []
    for m in RUN.finditer(text):
        rest = uncovered(m.start(), m.end(), covered)
        whole = len(rest) == 1 and rest[0] == m.span()
        if not rest or known_identifier(m[0]):
            continue
        if whole:
            spans = [m.span()] if is_random(m[0], encoding) else None
        else:  # beside base spans the rest of a random run is as secret as they are
            left = "".join(text[s:e] for s, e in rest)
            secret = len(left) >= MIN_REST and not known_identifier(left) and chars_per_token(left, encoding) <= MAX_RATIO
            secret = secret and chars_per_token(m[0], encoding) <= MAX_RATIO
            spans = [(s, e) for s, e in rest if PART.search(text, s, e)] if secret else None
        if spans is None:
            spans = [(s + a, s + b) for s, e in rest if e - s >= MIN_RUN for a, b in random_stretches(text[s:e], encoding)]
        out += [(s, 3, e) for s, e in spans]
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each secret replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


FIELDS = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("n_random", T.LongType()),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def scan(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): spans, their counts by kind and the digest of the base spans.

    ``ranks`` is the path of a tiktoken rank file and ``pattern`` its splitting pattern.
    Rows are independent: repeated and null doc_ids pass through.
    """

    def compute(texts):
        encoding = vocabulary(ranks, pattern)
        out = []
        for text in texts:
            base = base_spans(text) if text else []
            every = sorted(base + random_spans(text, base, encoding)) if text else []
            counts = [sum(k == i for _, k, _ in every) for i in range(4)]
            out.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)))
        return [list(c) for c in zip(*out)] or [[] for _ in FIELDS]

    names = ["doc_id", "text", *(f.name for f in FIELDS)]
    made = with_columns(only(documents, "doc_id", "text"), ["text"], FIELDS, compute)
    return split(made, names, ["doc_id", *names[2:]])


def redact(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``documents`` with secrets in ``text`` replaced by ``[kind]`` and ``n_chars``, where present, counted anew.

    Every row stays; a text without secrets and a null text are left as they are.
    """

    def compute(texts):
        encoding = vocabulary(ranks, pattern)
        out = []
        for text in texts:
            base = base_spans(text) if text else []
            spans = sorted(base + random_spans(text, base, encoding)) if text else []
            out.append(redacted(text, spans) if spans else None)
        return [out]

    made = with_columns(documents, ["text"], [T.StructField("clean", T.StringType())], compute)
    clean = F.col(made.columns[-1])
    for i, (name, kind) in enumerate(documents.dtypes):
        column = F.col(f"c{i}")
        if name == "text":
            made = made.withColumn(f"c{i}", F.coalesce(clean, column))
        elif name == "n_chars":
            made = made.withColumn(f"c{i}", F.when(clean.isNull(), column).otherwise(F.char_length(clean)).cast(kind))
    return original(made, documents)
