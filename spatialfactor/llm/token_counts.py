"""Token counts by prefix dynamic programming over a byte-pair vocabulary.

A byte-pair encoding is right exactly if each pair of neighbouring tokens is: encoding the bytes of the two gives the
two back. So the encoding of a prefix is that of a shorter prefix and one more token, and one pass over a piece of text
finds, for each prefix, its last token and its count: ``count[i] = count[i - len(last[i])] + 1``. Counts at every prefix
then answer truncation and budget questions without encoding again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import regex
import re
from pyspark.sql import DataFrame

from .common import map_rows

#: The pattern that the vocabulary's library cuts text with before it merges.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The code points with Unicode's White_Space property, which that pattern's \s means.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: White space and the word after it: no piece of PRETOKEN reaches over the end of such a unit.
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
LEADING = re.compile(f"[{WHITE}]*")
#: Units remembered in a worker; all are forgotten when there are more, so memory is bounded.
REMEMBERED = 200_000


def byte_symbols() -> dict[str, int]:
    """The vocabulary's letter for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Exact token counts at every prefix for a byte-level vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters = byte_symbols()
        as_bytes = lambda symbols: bytes(letters[c] for c in symbols)
        self.special = [t["content"] for t in described.get("added_tokens", [])]
        taken = set(self.special)
        self.tokens = {as_bytes(s): i for s, i in described["model"]["vocab"].items() if s not in taken}
        #: Of the last three bytes of a text: the length of the longest token that ends so.
        self.reach: dict[bytes, int] = {}
        for token in self.tokens:
            for n in (1, 2, 3):
                self.reach[token[-n:]] = max(self.reach.get(token[-n:], 0), len(token))
        #: Of a token: the two that its merge joins. Of two tokens: when they merge, and to which token.
        self.halves: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], tuple[int, int]] = {}
        for when, merge in enumerate(described["model"]["merges"]):
            left, right = (as_bytes(s) for s in (merge.split(" ") if isinstance(merge, str) else merge))
            pair = self.tokens[left], self.tokens[right]
            whole = self.tokens[left + right]
            self.joins[pair] = when, whole
            self.halves.setdefault(whole, pair)
        self.when = {t: self.joins[pair][0] for t, pair in self.halves.items()}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._fits: dict[tuple[int, int], bool] = {}
        self._counts: dict[str, int] = {}
        self._rows: dict[bytes, tuple[int, int]] = {b"": (-1, 0)}

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stand next to each other in an encoding.

        Undo the later of the merges that made the two, again and again: what then meets at the border must not be a
        pair that merges before the merge just undone would have happened, since it would have been joined first. Of
        equal merges the left one happens first.
        """
        key = left, right
        if (known := self._fits.get(key)) is not None:
            return known
        made, never = self.when, -1
        latest = 1 << 60  # a border pair that merges before this, or at it where the left one goes first, breaks the two
        strict = True
        known = True
        while True:
            join = self.joins.get((left, right))
            if join is not None and (join[0] < latest or (not strict and join[0] == latest)):
                known = False
                break
            when_left, when_right = made.get(left, never), made.get(right, never)
            if when_left == never and when_right == never:
                break
            if when_left > when_right:
                # the left token's merge comes last: a border pair of equal rank would lie right of it, hence come later
                latest, strict, left = when_left, True, self.halves[left][1]
            else:
                # the right token's merge: a border pair of equal rank lies left of it and comes first
                latest, strict, right = when_right, False, self.halves[right][0]
        if len(self._fits) >= REMEMBERED * 5:
            self._fits.clear()
        self._fits[key] = known
        return known

    def byte_prefixes(self, data: bytes) -> list[int]:
        """Token counts of ``data[:i]`` for i from 0 to its length, as one piece of the pattern."""
        tokens, fits, known, reach = self.tokens, self.fits, self._fits, self.reach
        last, counts = [-1], [0]
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - reach.get(data[max(0, end - 3) : end], 3)), end):
                token = tokens.get(data[start:end])
                if token is not None:
                    left = last[start]
                    if left < 0 or (ok := known.get((left, token))) or (ok is None and fits(left, token)):
                        last.append(token)
                        counts.append(counts[start] + 1)
                        break
            else:
                raise ValueError("the vocabulary lacks a token for a single byte")
        return counts

    def piece_count(self, data: bytes) -> int:
        """The last entry of ``byte_prefixes``; the table's rows are kept by prefix, so pieces that start alike share them."""
        size = len(data)
        if size > 48:
            return self.byte_prefixes(data)[-1]
        rows = self._rows
        if (row := rows.get(data)) is not None:
            return row[1]
        if len(rows) > REMEMBERED * 2:
            rows.clear()
            rows[b""] = (-1, 0)
        done = size - 1
        while data[:done] not in rows:
            done -= 1
        tokens, fits, known, reach = self.tokens, self.fits, self._fits, self.reach
        for end in range(done + 1, size + 1):
            for start in range(max(0, end - reach.get(data[max(0, end - 3) : end], 3)), end):
                token = tokens.get(data[start:end])
                if token is not None:
                    left, before = rows[data[:start]]
                    if left < 0 or (ok := known.get((left, token))) or (ok is None and fits(left, token)):
                        row = rows[data[:end]] = token, before + 1
                        break
            else:
                raise ValueError("the vocabulary lacks a token for a single byte")
        return row[1]

    def unit_count(self, unit: str) -> int:
        """Tokens of a unit (white space and a word)."""
        if (known := self._counts.get(unit)) is None:
            known = sum(self.piece_count(p.encode()) for p in PRETOKEN.findall(unit))
            if len(unit) <= 64:
                if len(self._counts) >= REMEMBERED:
                    self._counts.clear()
                self._counts[unit] = known
        return known

    def unit_prefixes(self, unit: str) -> list[int]:
        """Token counts of ``unit[:p]`` for p from 0 to its length in code points, each as the end of a text."""
        white = LEADING.match(unit).end()
        table = self.byte_prefixes(unit[:white].encode())
        out = [table[len(unit[:p].encode())] for p in range(white + 1)]
        before, at = 0, 0
        for piece in PRETOKEN.findall(unit):
            table, size = self.byte_prefixes(piece.encode()), 0
            for i, c in enumerate(piece, 1):
                size += len(c.encode())
                if at + i > white:
                    # a cut contraction is an apostrophe and letters
                    cut = i == 2 and len(piece) == 3 and piece in ("'re", "'ve", "'ll")
                    out.append(before + (2 if cut else table[size]))
            before, at = before + table[-1], at + len(piece)
        return out

    def _sections(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text, and special strings, which the library takes as one token each."""
        at = 0
        for found in self.split_special.finditer(text) if self.split_special and any(s in text for s in self.special) else ():
            if found.start() > at:
                yield text[at : found.start()], False
            yield found[0], True
            at = found.end()
        if at < len(text):
            yield text[at:], False

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        known, total = self._counts, 0
        for section, special in self._sections(text):
            if special:
                total += 1
            else:
                for unit in UNIT.findall(section):
                    got = known.get(unit)
                    total += self.unit_count(unit) if got is None else got
        return total

    def prefixes(self, text: str) -> list[int]:
        """Token counts at every prefix, in code points; a prefix that cuts a special string sees ordinary text."""
        out, last = [0], 0
        for section, special in self._sections(text):
            base = out[-1]
            if special:
                # the cut string joins what stands before it, so only here is a prefix counted from the last unit on
                head, known = text[last : len(out) - 1], out[last]
                out += [known + self.count(head + section[:i]) for i in range(1, len(section))] + [base + 1]
                last = len(out) - 1
            else:
                for unit in UNIT.findall(section):
                    base, last = out[-1], len(out) - 1
                    out += [base + n for n in self.unit_prefixes(unit)[1:]]
                out[-1] = base + self.unit_count(unit)
        return out

    def truncate(self, text: str, budget: int) -> int:
        """Code points of the longest start of ``text`` that ends in or at a unit and has at most ``budget`` tokens."""
        at = total = 0
        for section, special in self._sections(text):
            for unit in [section] if special else UNIT.findall(section):
                n = 1 if special else self.unit_count(unit)
                if total + n > budget:
                    fits = [0] if special else [p for p, c in enumerate(self.unit_prefixes(unit)) if total + c <= budget]
                    return at + max(fits, default=0)
                total, at = total + n, at + len(unit)
        return at


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: n_bytes, n_tokens, over_limit (more than ``limit`` tokens) and limit_chars.

    ``limit_chars`` is the number of code points of the longest start that keeps to the limit. Rows keep their
    multiplicity. A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeated; other columns of ``docs``
    are ignored, whatever their names. No shuffle; a task holds a few hundred texts at a time. ``vocabulary`` is a path
    of each executor's own installation.
    """

    def rows(batches):
        counts = counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            n = [counts.count(t) for t in texts]
            yield {
                "id": batch["id"],
                "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                "n_tokens": n,
                "over_limit": [k > limit for k in n],
                "limit_chars": [counts.truncate(t, limit) if k > limit else len(t) for t, k in zip(texts, n, strict=True)],
            }

    slim = docs.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS id", f"`{text_column}` AS text")
    out = map_rows(slim, rows, "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, limit_chars bigint")
    return out.withColumnRenamed("id", id_column)
