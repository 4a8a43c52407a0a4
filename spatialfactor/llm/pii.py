"""Personal data: exact patterns, and a semi-Markov conditional random field that finds further spans.

The field scores whole spans: how many digits, which groups and separators, check digits, what stands next to it. Dynamic
programming over an island of text (words with digits or an at sign, and what stands between) sums over all ways to cut it
into plain atoms and entities of bounded length, so boundaries and types are chosen jointly. Weights are fitted by maximum
likelihood on islands of a bounded sample of documents, labelled by the exact patterns, and on copies of them written in
ways that the patterns miss. Secrets (keys, tokens, passwords) have no exact pattern of their own: the field learns them
from values that the sample's texts name as such, and finds them by their letters and their surroundings.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, kept_by_worker, map_rows, text_sample

#: The kinds, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
EXACT_KINDS = KINDS[:4]
SECRET = 4
TRIGGER = re.compile(r"[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
#: Islands: words with a digit or an at sign, single spaces between them.
ISLAND = re.compile(r"(?<![^\s])[^\s0-9@]*[0-9@][^\s]*(?: [^\s0-9@]*[0-9@][^\s]*)*")
#: Atoms: a long run of letters and digits mixed, digits, letters, or one other character.
ATOM = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{12,}|[0-9]+|[^\W\d_]+|\s|.", re.DOTALL)
#: Names that texts give to secrets, and the form of a cloud key's id; the field's examples of secrets.
NAMED_SECRET = re.compile(r"\b(?:password|passwd|pwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9]{12,})(?![A-Za-z0-9])|\b(AKIA[0-9A-Z]{16})\b", re.IGNORECASE)
NAME = re.compile(r"([^\W\d_]+)[^\w]{0,6}$")
#: Characters before an island in which its name is looked for.
BEFORE = 24
#: Decoded islands that a worker remembers; all are forgotten when there are more.
REMEMBERED = 50_000
#: Atoms of an entity, at most. Posterior from which on a span is added.
LONGEST, SURE = 16, 0.9
SHOWN = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]"}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def octet(digits: str) -> bool:
    return len(short := digits.lstrip("0")) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of the exact patterns, by start and kind; matches that fail a test are dropped."""
    found: list[tuple[int, int, int]] = []
    if not TRIGGER.search(text):
        return found
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            found.append((start, 0, domain.end()))
            done = domain.end()
        else:
            # what stands before this sign can't begin a later match: the sign itself is no part of one
            done = at + 1
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(map(octet, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@dataclass
class Island:
    """Atoms of an island by their borders, and the candidate segments (first atom, after the last, features)."""

    borders: list[int]
    segments: list[tuple[int, int, list[str]]]


def char_class(c: str) -> str:
    return "end" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def named_secrets(text: str) -> list[tuple[int, int, int]]:
    """Spans that a text names as secrets, for the fit; values without a digit or without a letter are none."""
    spans = [m.span(1 if m[1] else 2) for m in NAMED_SECRET.finditer(text)]
    return [(a, SECRET, b) for a, b in spans if not text[a:b].isdigit() and not text[a:b].isalpha()]


def letters_of(value: str) -> list[str]:
    """Features of a long run of letters and digits."""
    letters, n = [c for c in value if c.isalpha()], sum(c.isdigit() for c in value)
    case = "upper" if all(c.isupper() for c in letters) else "lower" if all(c.islower() for c in letters) else "mixed"
    hexadecimal = all(c in "0123456789abcdefABCDEF" for c in value)
    return ["run", f"run={case}{hexadecimal}", f"runlength={min(len(value), 64) // 4}", f"rundigits={10 * n // len(value)}", f"runstart={value[:4] if value[:4].isalpha() else '-'}"]


def island_of(text: str, before: str = "") -> Island:
    """``before``: the text that precedes the island."""
    atoms = ATOM.findall(text)
    borders = [0]
    for a in atoms:
        borders.append(borders[-1] + len(a))
    kind = ["m" if len(a) > 1 and a.isalnum() and not a.isdigit() and not a.isalpha() else "d" if a[0] in "0123456789" else "a" if a[0].isalpha() else "s" if a[0].isspace() else a for a in atoms]
    segments = []
    for i, first in enumerate(kind):
        if first not in ("d", "a", "m", "+", "("):
            continue
        digits, groups, shape = "", 0, []
        for j in range(i, min(len(atoms), i + LONGEST)):
            k = kind[j]
            if k == "d":
                digits += atoms[j]
                groups += 1
                shape.append(f"d{min(len(atoms[j]), 5)}")
            elif k == "m":
                digits += NOT_DIGIT.sub("", atoms[j])
                shape.append(k)
            elif not shape or shape[-1] != k:
                shape.append(k)
            # an entity ends with a word character and holds digits or an at sign
            if k not in ("d", "a", "m") or not (digits or "@" in shape):
                continue
            used = set(kind[i : j + 1])
            n, a, b = len(digits), borders[i], borders[j + 1]
            left, right = char_class(text[a - 1 : a] if a else ""), char_class(text[b : b + 1])
            features = ["bias", f"digits={min(n, 20)}", f"groups={min(groups, 8)}", f"seps={''.join(sorted(used - {'d', 'a'}))}", f"letters={'a' in used}", f"L={left}", f"R={right}", f"first={first}", f"last={k}"]
            features.append(f"R2={right}{char_class(text[b + 1 : b + 2])}")
            if k == "m" and j == i:
                features += letters_of(atoms[i])
                name = NAME.search((before + text[:a])[-BEFORE:])
                features.append(f"name={name[1].lower() if name else '-'}")
            # longer shapes are too rare to learn from
            if len(shape) <= 12:
                features.append("shape=" + "".join(shape))
            if 12 <= n <= 19 and used.isdisjoint("am"):
                features.append(f"luhn={luhn(digits)}")
            parts = "".join(atoms[i : j + 1]).split(".")
            if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
                features.append(f"octets={all(map(octet, parts))}")
            if "@" in used:
                features.append(f"address={shape.count('@') == 1 and '.' in shape[shape.index('@'):]}")
            segments.append((i, j + 1, features))
    return Island(borders, segments)


class Field:
    """Weights of features by kind; plain atoms score 0."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights

    def scores(self, island: Island) -> np.ndarray:
        names, out = self.names, np.empty((len(island.segments), len(KINDS)))
        for s, (_, _, features) in enumerate(island.segments):
            out[s] = self.weights[[names[f] for f in features if f in names]].sum(axis=0)
        return out

    def marginals(self, island: Island, scores: np.ndarray) -> tuple[np.ndarray, float]:
        """Posterior of each segment and kind, and the logarithm of the sum over all ways to cut the island."""
        n = len(island.borders) - 1
        best = scores.max(axis=1, initial=-np.inf)
        total = best + np.log(np.exp(scores - best[:, None]).sum(axis=1)) if len(scores) else best
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (i, j, _) in enumerate(island.segments):
            ends[j].append(s)
            starts[i].append(s)
        forward, backward = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            terms = [forward[j - 1], *(forward[island.segments[s][0]] + total[s] for s in ends[j])]
            top = max(terms)
            forward[j] = top + np.log(sum(np.exp(t - top) for t in terms))
        for i in range(n - 1, -1, -1):
            terms = [backward[i + 1], *(backward[island.segments[s][1]] + total[s] for s in starts[i])]
            top = max(terms)
            backward[i] = top + np.log(sum(np.exp(t - top) for t in terms))
        if not len(scores):
            return np.empty((0, len(KINDS))), forward[n]
        base = np.asarray([forward[i] + backward[j] for i, j, _ in island.segments]) - forward[n]
        return np.exp(scores + base[:, None]), forward[n]

    def decode(self, island: Island) -> list[tuple[int, int, int, float]]:
        """Best cut: entities (start, kind, end) in characters with their posteriors."""
        scores = self.scores(island)
        if not len(scores) or scores.max() <= 0:
            return []
        n = len(island.borders) - 1
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (_, j, _) in enumerate(island.segments):
            ends[j].append(s)
        kinds, top = scores.argmax(axis=1), scores.max(axis=1)
        value, back = [0.0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for s in ends[j]:
                if (v := value[island.segments[s][0]] + top[s]) > value[j]:
                    value[j], back[j] = v, s
        sure, _ = self.marginals(island, scores)
        out, j = [], n
        while j:
            if (s := back[j]) < 0:
                j -= 1
            else:
                i, to, _ = island.segments[s]
                out.append((island.borders[i], int(kinds[s]), island.borders[to], float(sure[s, kinds[s]])))
                j = i
        return out[::-1]


def otherwise_written(kind: int, span: str, turn: int) -> str | None:
    """The span in a way that the exact pattern misses."""
    if kind in (0, SECRET):
        return None
    if kind == 2:
        digits = NOT_DIGIT.sub("", span)
        return ("." if turn % 2 else "/").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        rest = span[1:]
        return ("00" + rest, rest, "(+" + rest[0] + ")" + rest[1:])[turn % 3]
    return span.replace(".", " . ") if turn % 4 == 0 else None


def fit_field(texts: list[str], rounds: int = 6, rate: float = 0.5, penalty: float = 1e-3, most: int = 1000) -> Field | None:
    """Maximum likelihood by adaptive gradient steps, island by island, in the order given."""
    examples: list[tuple[Island, set[tuple[int, int, int]]]] = []
    for text in texts:
        spans = base_spans(text)
        touched = lambda a, b: any(x < b and a < y for x, _, y in spans)  # noqa: B023, E731
        spans = sorted(spans + [s for s in named_secrets(text) if not touched(s[0], s[2])])
        for m in ISLAND.finditer(text):
            if m.end() - m.start() > 200 or len(examples) >= most:
                continue
            inside = [(a - m.start(), k, b - m.start()) for a, k, b in spans if m.start() <= a and b <= m.end()]
            clear = [s for i, s in enumerate(inside) if not i or s[0] >= inside[i - 1][2]]
            if len(clear) < len(inside):
                continue
            # the island with the characters around it, so that what stands next to a span is seen
            before = text[max(0, m.start() - BEFORE) : m.start()]
            examples.append((island_of(m[0], before), set(clear)))
            if clear:
                built, moved, at = "", set(), 0
                for a, k, b in clear:
                    new = otherwise_written(k, m[0][a:b], len(examples)) or m[0][a:b]
                    built += m[0][at:a]
                    moved.add((len(built), k, len(built) + len(new)))
                    built, at = built + new, b
                examples.append((island_of(built + m[0][at:], before), moved))
    if not examples:
        return None
    names: dict[str, int] = {}
    for island, _ in examples:
        for _, _, features in island.segments:
            for f in features:
                names.setdefault(f, len(names))
    field = Field(names, np.zeros((len(names), len(KINDS))))
    squares = np.full(field.weights.shape, 1e-2)
    # shapes seen once would let the field learn examples by heart
    for _ in range(rounds):
        for island, gold in examples:
            if not island.segments:
                continue
            scores = field.scores(island)
            expected, _ = field.marginals(island, scores)
            for s, (i, j, _) in enumerate(island.segments):
                for k in range(len(KINDS)):
                    if (island.borders[i], k, island.borders[j]) in gold:
                        expected[s, k] -= 1.0
            wrong = np.flatnonzero(np.abs(expected).max(axis=1) > 1e-3)
            if not len(wrong):
                continue
            ids = np.concatenate([[names[f] for f in island.segments[s][2]] for s in wrong]).astype(np.int64)
            push = np.repeat(expected[wrong], [len(island.segments[s][2]) for s in wrong], axis=0)
            touched, where = np.unique(ids, return_inverse=True)
            gradient = np.zeros((len(touched), len(KINDS)))
            np.add.at(gradient, where, push)
            gradient += penalty * field.weights[touched]
            squares[touched] += gradient**2
            field.weights[touched] -= rate * gradient / np.sqrt(squares[touched])
    return field


#: Decoded islands of the field that this worker applies, by text and what stands before.
_decoded: dict[tuple[str, str], list[tuple[int, int, int, float]]] = {}
_decoded_by: list[int] = []


@kept_by_worker
def forget() -> None:
    _decoded.clear()
    _decoded_by.clear()


def decoded(field: Field, island: str, before: str) -> list[tuple[int, int, int, float]]:
    """The island's entities; islands that come again are decoded once."""
    key = hash(field.weights.tobytes())
    if _decoded_by != [key] or len(_decoded) > REMEMBERED:
        _decoded.clear()
        _decoded_by[:] = [key]
    if (found := _decoded.get((island, before))) is None:
        found = _decoded[island, before] = field.decode(island_of(island, before))
    return found


def all_spans(text: str, field: Field | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The exact patterns' spans, and these with the field's that touch none of them."""
    base = base_spans(text)
    if field is None or not TRIGGER.search(text):
        return base, base
    added = []
    taken = sorted((a, b) for a, _, b in base)
    furthest = [0]
    for _, b in taken:
        furthest.append(max(furthest[-1], b))
    starts = [a for a, _ in taken]
    for m in ISLAND.finditer(text):
        low = int(np.searchsorted(starts, m.start(), side="left"))
        # an island that the exact patterns cover has nothing to add
        if low < len(starts) and starts[low] == m.start() and furthest[low + 1] >= m.end() and taken[low][1] >= m.end():
            continue
        for a, k, b, sure in decoded(field, m[0], text[max(0, m.start() - BEFORE) : m.start()]):
            a, b = a + m.start(), b + m.start()
            before = int(np.searchsorted(starts, b, side="left"))
            if sure >= SURE and furthest[before] <= a:
                added.append((a, k, b))
    return base, sorted(base + added) if added else base


def sample_texts(docs: DataFrame, sample: int, longest: int, text_column: str = "text") -> list[str]:
    """Texts with digits or at signs, at most ``sample``, of at most ``longest`` characters: those with the least hash."""
    some = docs.select(F.col(text_column).alias("text")).where((F.length("text") <= longest) & F.col("text").rlike("[0-9@]"))
    return [r["text"] for r in text_sample(some, sample)]


def find_personal_data(docs: DataFrame, sample: int = 600, longest: int = 5000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: numbers of the exact patterns' spans by kind, their digest, and all spans.

    A null text is empty; ids may be null or repeated and rows keep their multiplicity; other columns are ignored. The
    field is fitted on at most ``sample`` texts of at most ``longest`` characters, of which it learns from the first 1,000
    islands of at most 200 characters and from shapes of at most 12 parts, and is applied to whole texts of any length;
    without texts to fit on, only the patterns apply. ``spans`` are those of the exact patterns and the field's, which
    may also be of kind secret. One pass, no shuffle.
    """
    field = fit_field(sample_texts(docs, sample, longest, text_column))

    def rows(batches):
        for batch in batches:
            got = [all_spans(t or "", field) for t in batch["text"].to_pylist()]
            yield {
                "id": batch["id"],
                **{f"n_{kind}": [sum(s[1] == k for s in base) for base, _ in got] for k, kind in enumerate(EXACT_KINDS)},
                "base_sha256": [hashlib.sha256(show(base).encode()).hexdigest() for base, _ in got],
                "spans": [show(spans) for _, spans in got],
            }

    slim = docs.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS id", f"`{text_column}` AS text")
    out = map_rows(slim, rows, "id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_column)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of spans that overlap, replaced by its first kind's mark."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], SHOWN[KINDS[k]]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, sample: int = 600, longest: int = 5000, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """``docs`` with the spans in its texts replaced by marks and the length column brought up to date.

    Null and empty texts, repeated rows and rows without id stay as they are, texts of any length are read whole, and an
    empty table stays empty; without a length column none is added.
    """
    field = fit_field(sample_texts(docs, sample, longest, text_column))

    def rows(batches):
        for batch in batches:
            texts = batch[text_column].to_pylist()
            found = [all_spans(t, field)[1] if t else [] for t in texts]
            new = [redact(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            out = dict(batch) | {text_column: new}
            if length_column in batch:
                out[length_column] = [len(n) if s else old for n, s, old in zip(new, found, batch[length_column].to_pylist(), strict=True)]
            yield out

    return map_rows(docs, rows, ddl(docs))

