"""Token ids of whole texts with a word-splitting byte-pair tokenizer, for many words at a time.

The definition file fixes the vocabulary and the merges. A slice's words are looked
up by hash in a table of bounded size; the words it lacks are merged together, one
step for all of them at once, in numpy. Words with unusual characters go to the
tokenizers library, which every result equals.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import regex

from ._text import cut_spans, hash_spans, ranges, raw, word_spans

#: The pieces that the tokenizer's definition splits text into; a line end parts words here.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
#: Bytes of words that the fast way leaves to the library: control characters, "<" (special tokens), all beyond Latin letters.
ODD = np.ones(256, bool)
ODD[33:127], ODD[ord("<")], ODD[0x80:0xC0], ODD[0xC3], ODD[0xC5] = False, True, False, False, False
NONE = np.int32(1 << 30)


def invalid(body: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which words are not UTF-8."""
    view = body.tobytes()
    try:
        view.decode("utf-8")
        return np.zeros(len(off) - 1, bool)
    except UnicodeDecodeError:
        return np.array(["\ufffd" in view[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])


class WordTokens:
    """ids(texts) for one tokenizer definition whose words are split at white space, which it drops."""

    def __init__(self, definition: str, slots: int = 1 << 19, room: int = 1 << 23):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        model = json.loads(definition)["model"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if max(vocab.values(), default=0) >= 1 << 16:
            raise ValueError("ids are held in 16 bits: the tokenizer's vocabulary has to have 65,536 entries at most")
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint32)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.uint32)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*shown}))}
        end = model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.uint32)
        self.last = np.array([vocab[chars[b] + end] for b in range(256)], np.uint32)
        self.slots, self.room = slots, room
        self.clear()

    def clear(self) -> None:
        self.held, self.at, self.n = (np.zeros(self.slots, t) for t in (np.uint64, np.int32, np.int32))
        self.pool, self.used = np.zeros(self.room, np.uint16), 0

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a << np.uint32(16) | b
        k = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[k] == pair, self.rank[k], NONE)

    def merge(self, body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (none empty) and the number of ids of each; the lowest-ranked pair of each piece is merged in each step."""
        sym = self.inner[body]
        sym[off[1:] - 1] = self.last[body[off[1:] - 1]]
        piece = np.repeat(np.arange(len(off) - 1), np.diff(off))
        rank = np.full(len(sym), NONE, np.int32)
        inside = np.flatnonzero(piece[:-1] == piece[1:])
        rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        done_sym, done_piece = [], []
        while len(sym):
            starts = np.r_[0, np.flatnonzero(np.diff(piece)) + 1]
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            live = least < NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_piece.append(piece[~live])
                sym, piece, rank, least = sym[live], piece[live], rank[live], least[live]
                if not len(sym):
                    break
            hit = rank == least
            at = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, (np.diff(at) > 1) | (piece[at[1:]] != piece[at[:-1]])]) - 1
            first = at[np.r_[0, np.flatnonzero(np.diff(run)) + 1]]
            at = at[(at - first[run]) % 2 == 0]
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            new = (np.cumsum(stay) - 1)[at]
            sym, piece, rank = sym[stay], piece[stay], rank[stay]
            for i in (new, new - 1):
                i = i[i >= 0]
                j = np.minimum(i + 1, len(sym) - 1)
                rank[i] = np.where((piece[i] == piece[j]) & (i != j), self.ranks(sym[i], sym[j]), NONE)
        if not done_sym:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        sym, piece = np.concatenate(done_sym), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return sym[order], np.bincount(piece, minlength=len(off) - 1)

    def encode(self, body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given words and the number of ids of each. Bytes that are no UTF-8 count as the replacement character."""
        odd = (np.add.reduceat(ODD[body], off[:-1]) > 0) | invalid(body, off)
        if odd.any():
            n = np.diff(off)
            ids, count = [None, None], np.zeros(len(n), np.int64)
            text = [bytes(body[off[k] : off[k + 1]]).decode("utf-8", "replace") for k in np.flatnonzero(odd)]
            found = [e.ids for e in self.tokenizer.encode_batch(text, add_special_tokens=False)]
            count[odd] = [len(f) for f in found]
            ids[1] = np.array([i for f in found for i in f], np.uint32)
            ids[0] = np.zeros(0, np.uint32)
            if not odd.all():
                ids[0], count[~odd] = self.encode(*cut_spans(body, off[:-1][~odd], n[~odd]))
            out = np.zeros(count.sum(), np.uint32)
            of_odd = np.repeat(odd, count)
            out[of_odd], out[~of_odd] = ids[1], ids[0]
            return out, count
        joined = np.insert(body, off[1:], 10).tobytes().decode("utf-8")
        parts = PIECES.findall(joined.replace("Σ", "σ").lower())
        coded = pa.array(parts, pa.string()).dictionary_encode()
        code = coded.indices.to_numpy()
        end = code == coded.dictionary.index(pa.scalar("\n")).as_py()
        ids, count = self.merge(*raw(coded.dictionary))
        code = code[~end]
        n = count[code]
        of_word = np.repeat((np.cumsum(end) - 0)[~end], n)
        return ids[np.repeat((np.cumsum(count) - count)[code], n) + ranges(n)], np.bincount(of_word, minlength=len(off) - 1)

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (32 bits, little-endian), each text closed by end_id, and n + 1 offsets."""
        body, starts, lengths, offsets = word_spans(texts, lower=False)
        key = hash_spans(body, starts, lengths) | np.uint64(1)
        slot = (key >> np.uint64(20)).astype(np.int64) % self.slots
        known = self.held[slot] == key
        table, first, n = self.pool, self.at[slot], self.n[slot]
        if not known.all():
            lost = np.flatnonzero(~known)
            _, pick, back = np.unique(key[lost], return_index=True, return_inverse=True)
            pick = lost[pick]
            ids, count = self.encode(*cut_spans(body, starts[pick], lengths[pick]))
            if self.used + len(ids) > self.room and len(ids) <= self.room // 2:
                held = self.pool[: self.used].copy()
                self.clear()  # a full table starts anew
            else:
                held = self.pool[: self.used]
            table = np.r_[held, ids.astype(np.uint16)]
            at = len(held) + np.cumsum(count) - count
            first, n = first.copy(), n.copy()
            first[lost], n[lost] = at[back], count[back]
            if self.used + len(ids) <= self.room:
                self.pool[self.used : self.used + len(ids)] = ids
                self.held[slot[pick]], self.at[slot[pick]], self.n[slot[pick]] = key[pick], self.used + np.cumsum(count) - count, count
                self.used += len(ids)
        total = np.r_[0, np.cumsum(n)]
        ends = total[offsets[1:]]
        spot = ends + np.arange(len(ends))  # of the end ids
        out = np.full(total[-1] + len(ends), end_id, "<u4")
        body_at = np.ones(len(out), bool)
        body_at[spot] = False
        out[body_at] = table[np.repeat(first - total[:-1], n) + np.arange(total[-1])]
        return out, np.r_[0, spot + 1]
