"""SentencePiece merge-type encoding by backtracking, and decoding.

Normal pieces sit in an Aho-Corasick automaton, which gives every piece that occurs in a run of text and so the
longest at each position. The encoder goes left to right, takes the longest piece, and accepts it if it and
the last piece are compatible: merging their joined text anew gives exactly these two (followed backwards from
the edge between them, see ``remerge``). If not, it tries the next
shorter piece, and if none is left it steps back over the last piece; a bitfield keeps positions from which the
rest was found impossible. Adjacent compatibility is enough: merges act within final pieces only, so a
sequence is the encoding if and only if each pair of neighbours is the encoding of its own text.

The model's normaliser must be the identity with a leading space mark (checked at load); no other is supported.
"""

from __future__ import annotations

import re

import ahocorasick
import sentencepiece

from junctura.llm.common import resident

MARK = "▁"
#: Longest run that is kept in a memo, and entries of the memos before they start anew.
MEMO_CHARS, MEMO_ROWS, PAIR_ROWS = 64, 200_000, 250_000


class PieceModel:
    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._check(model)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        #: Merges with the highest score go first; at equal scores the leftmost.
        self.score = [model.get_score(i) for i in range(n)]
        self.chars = {p for p in self.ids if len(p) == 1}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes) if model.is_byte(i)}
        if n >= 1 << 16 or model.unk_id() != 0:
            raise ValueError("ids of 16 bits, 0 for unknown, are needed")
        if len(self.byte_of) != 256:
            raise ValueError("the model has no byte fallback")
        self.text_of = [chr(b) if (b := self.byte_of.get(i)) is not None else "" if special[i] else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.high = {i for i, b in self.byte_of.items() if b > 127}
        self.digits = list(map(str, range(n)))
        #: No piece has a mark after another character: text can be cut before each first mark.
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces cross words")
        self.find = ahocorasick.Automaton()
        #: By piece: when it is made (characters are there from the start) and what its last merge joins.
        self.made = [0] * n
        self.halves: list[tuple[int, int] | None] = [None] * n
        order = sorted(self.ids.values(), key=lambda i: -self.score[i])
        for when, i in enumerate(order, 1):
            p = self.pieces[i]
            whole, halves = self.merge(p)
            if whole == [i]:
                self.find.add_word(p, (i, len(p)))
                if len(p) > 1:
                    self.made[i], self.halves[i] = when, halves
        self.find.make_automaton()
        self.size_of = [len(p) for p in self.pieces]
        #: By piece: the longest piece that it begins with, 0 (the unknown piece) if none.
        self.shorter = [0] * n
        for p, i in self.ids.items():
            self.shorter[i] = next((k for c in range(len(p) - 1, 0, -1) if (k := self.ids.get(p[:c])) is not None and p[:c] in self.find), 0)
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, list[int]] = {}

    @staticmethod
    def _check(model: sentencepiece.SentencePieceProcessor) -> None:
        for text in ("a  b", " a ", "ﬁ ①", "Á"):
            if model.decode(model.encode(text)) != text or model.encode(text)[0] == model.bos_id():
                raise ValueError("the model's normaliser is not the identity")

    def merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Ids of ``text`` (known characters) by merging, the best pair first, the leftmost of equal ones; and what the last merge joined."""
        parts = list(text)
        ids, score = self.ids, self.score
        last = None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or score[k] > best):
                    best, at = score[k], i
            if best is None:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids[p] for p in parts], last and (ids[last[0]], ids[last[1]])

    def remerge(self, a: int, b: int) -> bool:
        """Whether merging the joined text of ``a`` and ``b`` anew gives these two.

        Their merges are taken back from the last, at the edge between them, and each pair that then meets there
        must not be one that merges earlier than the merge taken back (or at the same time, but further left).
        """
        ids, pieces, made, halves = self.ids, self.pieces, self.made, self.halves
        before = len(pieces) + 1  # merges made before this time have happened
        while True:
            joined = ids.get(pieces[a] + pieces[b])
            if joined is not None and made[joined] and made[joined] < before:
                return False
            if made[a] > made[b]:
                before, a = made[a], halves[a][1]
            elif made[b]:
                before, b = made[b] + 1, halves[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 16 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_ROWS:
                self.pairs.clear()
            known = self.pairs[key] = self.remerge(a, b)
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of a run of known characters."""
        n = len(text)
        longest = [0] * n
        for end, (piece, size) in self.find.iter(text):  # a later end overwrites a shorter piece
            longest[end + 1 - size] = piece
        shorter, size_of, known = self.shorter, self.size_of, self.pairs
        out: list[int] = []
        at, last, failed = 0, 0, 0
        piece = longest[0]
        while True:
            while piece:
                after = at + size_of[piece]
                if not failed >> after & 1:
                    if not last:
                        break
                    fits = known.get(last << 16 | piece)
                    if fits or fits is None and self.compatible(last, piece):
                        break
                piece = shorter[piece]
            if piece:
                out.append(piece)
                if after == n:
                    return out
                at, last, piece = after, piece, longest[after]
            else:  # nothing leads on from here: take the last piece back and try its next shorter one
                failed |= 1 << at
                if not out:
                    raise ValueError("no encoding")
                piece = out.pop()
                at -= size_of[piece]
                piece, last = shorter[piece], out[-1] if out else 0

    def encode_run(self, run: str) -> list[int]:
        """Ids of text between cuts; characters without a piece become their bytes."""
        known = self.memo.get(run)
        if known is not None:
            return known
        chars = self.chars
        if chars.issuperset(run):
            out = self.backtrack(run) if run else []
        else:
            out, at = [], 0
            for i, c in enumerate(run):
                if c not in chars:
                    if at < i:
                        out += self.encode_run(run[at:i])
                    out += [self.bytes[b] for b in c.encode()]
                    at = i + 1
            if at < len(run):
                out += self.encode_run(run[at:])
        if len(run) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ROWS:
                self.memo.clear()
            self.memo[run] = out
        return out

    def runs(self, text: str) -> list[str]:
        """``text`` with its leading mark, cut before every first mark of a row of marks."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))
        return [MARK + w for w in text.split(" ")]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, encode_run = self.memo.get, self.encode_run
        for run in self.runs(text):
            out += get(run) or encode_run(run)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``: the first leading space is the encoder's and goes; runs of byte pieces are UTF-8, invalid ones U+FFFD."""
        text_of, byte_of = self.text_of, self.byte_of
        if self.high.isdisjoint(ids):
            out = "".join([text_of[i] for i in ids])
        else:
            parts: list[str] = []
            held = bytearray()
            for i in ids:
                b = byte_of.get(i)
                if b is not None:
                    held.append(b)
                    continue
                if held:
                    parts.append(_utf8(held))
                    held = bytearray()
                parts.append(text_of[i])
            parts.append(_utf8(held))
            out = "".join(parts)
        return out[1:] if ids and ids[0] not in byte_of and out.startswith(" ") else out


def _utf8(data: bytearray) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):  # each byte that begins no whole character is replaced by itself
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def piece_model(path: str) -> PieceModel:
    return resident(("pieces", path), lambda: PieceModel(path))
