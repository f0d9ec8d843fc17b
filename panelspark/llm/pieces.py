"""Byte-pair pieces by dynamic programming over prefixes.

Every prefix of a text has exactly one last piece under byte-pair merging. It is found from
left to right: the pieces that end at a position come from an Aho-Corasick automaton, and one
of them is the last piece if it may stand right behind the last piece of the prefix in front
of it. Whether two pieces may stand side by side depends on these two alone. A table of last
pieces and piece counts per prefix therefore answers how many tokens any prefix has, and the
ids of the whole text are read off backwards. The work is linear in the length of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import islice

import ahocorasick
import sentencepiece

SPACE = "▁"
# Words remembered per Python worker, the part kept when the memory is full, and the longest word kept.
REMEMBERED, KEPT, LONGEST = 400_000, 0.4, 48


class PieceTable:
    """Prefix tables for one vocabulary file of the sentencepiece library (kind: byte-pair).

    Pairs merge if their concatenation is a piece; the best score goes first, then the leftmost.
    """

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.text: list[str | bytes] = []
        self.byte_ids = [0] * 256
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.text.append(bytes([int(piece[3:5], 16)]))
                self.byte_ids[int(piece[3:5], 16)] = i
                continue
            plain = not (lib.is_control(i) or lib.is_unknown(i))
            self.text.append(piece if plain else "")
            if plain:
                self.score[piece], self.ids[piece] = lib.get_score(i), i
        self.size = [len(t) for t in self.text]
        # the two sides of every piece as merging builds them: (shapes, priority of the next merge)
        self.left: dict[int, list[tuple[str, float]]] = {}
        self.right: dict[int, list[tuple[str, float]]] = {}
        self.known = frozenset(c for c in self.ids if len(c) == 1)
        if any(not self.known.issuperset(p) for p in self.ids):
            raise ValueError("a piece holds a character that is no piece itself")
        self._splits: dict[str, tuple[str, str] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or self._last_merge(piece):
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        # pieces never reach over these places, so the parts between them are independent
        pieces = "\n".join(self.ids)
        breaks = "" if "\n" in self.ids else "\n"
        self.independent = not re.search(f"[^{SPACE}\n]{SPACE}", pieces)
        letters = re.escape("".join(sorted(c for c in self.known if c.isalpha())))
        word = f"[^{SPACE}{breaks}]+"
        if not re.search(f"[{letters}][^{letters}\n]|[^{letters}{SPACE}\n][{letters}]", pieces):
            word = f"(?:[{letters}]+|[^{letters}{SPACE}{breaks}]+)"  # letters share no piece with other characters
        chunk = f"{SPACE}*{word}|{SPACE}+" + (f"|{breaks}" if breaks else "")
        self.chunks = re.compile(chunk) if self.independent else re.compile("(?s).+")
        self.runs = re.compile(f"[{re.escape(''.join(sorted(self.known)))}]+|.", re.DOTALL)

    # -- which pieces may be neighbours ------------------------------------------------------

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge completes ``piece``; None if merging never arrives there."""
        parts = list(piece)
        while len(parts) > 2:
            best = max(
                ((self.score.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))),
            )
            if best[0] == float("-inf"):
                return None
            at = -best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _side(self, piece: str, part: int) -> list[tuple[str, float]]:
        """Shapes of one outer side of ``piece`` from a single character to the whole, each with
        the priority (smaller is earlier) of the merge that ends it."""
        shapes = [piece]
        while len(shapes[-1]) > 1:
            shapes.append(self._last_merge(shapes[-1])[part])
        shapes.reverse()
        ends = [-self.score[later] for later in shapes[1:]] + [float("inf")]
        return list(zip(shapes, ends))

    def side_by_side(self, a: int, b: int) -> bool:
        """Does the text of ``a`` followed by that of ``b`` come out as just these two pieces?

        Plays the merges at the border in order of priority. A merge across the border goes
        first if it is better than the next merge in ``a`` (which starts further left and so
        wins a draw) and no worse than the next in ``b``.
        """
        xs = self.right.get(a) or self.right.setdefault(a, self._side(self.text[a], 1))
        ys = self.left.get(b) or self.left.setdefault(b, self._side(self.text[b], 0))
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            across = self.score.get(x + y)
            if across is not None and -across < x_ends and -across <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    # -- prefix tables -----------------------------------------------------------------------

    def prefixes(self, run: str) -> tuple[list[int], list[int]]:
        """Last piece and piece count of every prefix of ``run``, whose characters are all known."""
        last, count = [0] * (len(run) + 1), [0] * (len(run) + 1)
        pairs, width = self._pairs, len(self.text)
        for end, (size, piece) in self.automaton.iter(run):
            end += 1
            if last[end]:
                continue
            start = end - size
            if start:
                pair = last[start] * width + piece
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) > 500_000:
                        pairs.clear()
                    fits = pairs[pair] = self.side_by_side(last[start], piece)
                if not fits:
                    continue
            last[end], count[end] = piece, count[start] + 1
        return last, count

    def backwards(self, last: list[int]) -> list[int]:
        """The ids of a run, recovered from its table of last pieces."""
        ids, end, size = [], len(last) - 1, self.size
        while end:
            ids.append(last[end])
            end -= size[last[end]]
        ids.reverse()
        return ids

    def spaced(self, text: str) -> str:
        """The text as the library sees it: spaces marked, one in front; empty stays empty."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def chunk_ids(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for run in [chunk] if self.known.issuperset(chunk) else self.runs.findall(chunk):
            if run[0] in self.known:
                ids += self.backwards(self.prefixes(run)[0])
            else:
                ids += [self.byte_ids[b] for b in run.encode()]
        return ids

    def chunk_counts(self, chunk: str) -> list[int]:
        """Token counts of the prefixes of one chunk, from the empty prefix on."""
        counts = [0]
        for run in [chunk] if self.known.issuperset(chunk) else self.runs.findall(chunk):
            base = counts[-1]
            counts += [base + n for n in self.prefixes(run)[1][1:]] if run[0] in self.known else [base + len(run.encode())]
        return counts

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks.findall(self.spaced(text)) for i in self.chunk_ids(chunk)]

    def text_of(self, ids: Iterable[int]) -> str:
        """The pieces of ``ids`` set side by side, byte pieces joined to characters."""
        out, pending = [], b""
        for i in ids:
            piece = self.text[i]
            if isinstance(piece, bytes):
                pending += piece
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending = b""
            out.append(piece)
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: Iterable[int]) -> str:
        text = self.text_of(ids)
        return text[1:] if text.startswith(" ") else text


class Memory(dict):
    """Remembers what a function gave for a chunk; bounded, and long chunks are never kept.

    When it is full, the chunks met first stay: frequent words are met early.
    """

    def __init__(self, work, size: int = REMEMBERED):
        super().__init__()
        self.work, self.size = work, size

    def __missing__(self, chunk: str):
        value = self.work(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self.size:
                first = list(islice(self.items(), int(self.size * KEPT)))
                self.clear()
                self.update(first)
            self[chunk] = value
        return value


@lru_cache(maxsize=4)
def table_for(model: bytes) -> PieceTable:
    """One table per vocabulary and Python worker."""
    return PieceTable(model)
