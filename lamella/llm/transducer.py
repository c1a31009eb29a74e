"""Token counts by a tokenizer compiled to a deterministic transducer.

The tokenizer is byte-pair merging over characters with byte fallback (sentencepiece's BPE): of all neighbours whose
concatenation is a piece, the pair of best score merges, the leftmost on ties. For such merging two facts hold: cutting a
result at a token boundary leaves the result of the part before it, and a token may follow another exactly if merging
their concatenation gives back just the two. So the last token of each prefix of a text is found from the last tokens of
shorter prefixes, and what later characters depend on is finite: the suffixes read so far that can still become a
piece, and for each the token before it and how many tokens ago it was. These are the states; a transition on a
character has the change of the number of tokens as its output (it can be below 0, when pieces join).

Transitions are compiled when first met, into one integer table, and run over thousands of stretches of text at a time
with numpy. Where no piece can span two neighbouring characters the state no longer depends on anything before: texts are
cut there. A stretch without such a place (one word of a megabyte) is cut anywhere, and each chunk is a map of states
with counts, known for the states it has been run from. A first run starts from the state some characters earlier would
give; maps are composed by a prefix scan; chunks entered in another state are run from it and the scan is repeated, until
all agree. The count is exact then, whatever the first guesses were.

Null and empty texts have 0 tokens. Texts are never cut short; equal rows count alike; other columns don't matter. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamella.llm.common import small_batches, texts

#: Characters of a stretch that runs as one lane.
LANE = 256
#: Characters before a chunk from which its state is guessed.
WARM_UP = 48
#: States at which the table is begun anew: with their table about 250 MB.
STATES = 400_000
#: Columns of the table, of the characters that are most frequent where they first appear; the others go through a dictionary.
COLUMNS = 96
#: Bytes of text that are run together.
CHUNK = 3 << 20
SPACE = "▁"
_SHIFT, _BIAS = 6, 40


class Pieces:
    """The vocabulary as the transducer needs it, from a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        if any(m.is_unused(i) for i in ids):
            raise ValueError("unused pieces are not supported")
        self.rank = {m.id_to_piece(i): -m.get_score(i) for i in ids}
        self.prefixes = {x: x for p in self.rank for k in range(1, len(p)) for x in (p[:k],)}  # to itself, so that states share strings
        self.inside = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.chars = {c for p in self.rank for c in p}
        #: A text may be cut before a space that follows another character.
        self.cut_at_space = not any(b == SPACE and a != SPACE for a, b in self.inside)
        self._whole: dict[str, bool] = {}
        self._follows: dict[tuple[str, str], bool] = {}
        # How the library makes a text from its input: found by asking it.
        self.identity = all(m.normalize(x) == SPACE + x.replace(" ", SPACE) for x in ("a  b", "  Áﬁ\t\n ", "Ａ ")) and m.encode("") == []
        if not self.identity:
            raise ValueError("only models with a dummy prefix and no normalisation are supported")

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging, plainly."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, token: str) -> bool:
        if len(token) == 1:
            return True
        if token not in self.rank:
            return False
        out = self._whole.get(token)
        if out is None:
            out = self._whole[token] = self.merge(token) == [token]
        return out

    def follows(self, before: str, token: str) -> bool:
        """Whether merging leaves the two as they are."""
        if before[-1] + token[0] not in self.inside:
            return True
        out = self._follows.get((before, token))
        if out is None:
            if len(self._follows) > 300_000:
                self._follows.clear()
            out = self._follows[before, token] = self.merge(before + token) == [before, token]
        return out

    def weight(self, token: str) -> int:
        """Tokens that it counts as: a character outside the vocabulary is written as its bytes."""
        return 1 if token in self.rank else len(token.encode())


START = (("", None, 0),)


class Transducer:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.columns: dict[int, int] = {}
        self.column_of = np.full(0x110000, -1, np.int16)
        self.clear()

    def clear(self) -> None:
        self.number = {START: 0}
        self.states = [START]
        self.shared: dict[tuple, tuple] = {}
        self.table = np.full((1024, COLUMNS), -1, np.int32)
        self.table[:, 0] = (np.arange(1024) << _SHIFT) + _BIAS  # column 0: nothing is read
        self.rare: dict[tuple[int, int], int] = {}

    def number_of(self, state) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
            if n >= len(self.table):
                more = np.full((max(1024, len(self.table) // 2), COLUMNS), -1, np.int32)
                more[:, 0] = ((len(self.table) + np.arange(len(more))) << _SHIFT) + _BIAS
                self.table = np.concatenate((self.table, more))
        return n

    def step(self, number: int, char: str) -> int:
        """The transition as (next state << _SHIFT) + output + _BIAS."""
        p, state = self.pieces, self.states[number]
        for suffix, before, back in state:
            token = suffix + char
            if p.whole(token) and (before is None or p.follows(before, token)):
                output = p.weight(token) - back
                break
        else:
            raise AssertionError("a prefix without a last token")
        share, after = self.shared.setdefault, []
        for s, before, back in state:
            longer = p.prefixes.get(s + char)
            if longer is not None:
                x = (longer, None if before is None or (not s and before[-1] + char not in p.inside) else before, back + output)
                after.append(share(x, x))
        x = ("", token if char in p.chars else None, 0)  # nothing joins a character that no piece has
        after.append(share(x, x))
        if not 0 <= output + _BIAS < 1 << _SHIFT:
            raise OverflowError(f"a transition that emits {output} tokens doesn't fit in {_SHIFT} bits")
        return (self.number_of(tuple(after)) << _SHIFT) + output + _BIAS

    def entries(self, at: np.ndarray, codes: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The transitions of states `at` on characters; missing ones are compiled."""
        out = self.table[at, columns]
        if (out < 0).any():
            missing = np.flatnonzero((out < 0) & (columns >= 0))
            if len(missing):
                pairs = np.unique(at[missing].astype(np.int64) << 32 | codes[missing])
                for pair in pairs.tolist():
                    s, c = pair >> 32, pair & 0xFFFFFFFF
                    value = self.step(s, chr(c))
                    self.table[s, self.columns[c]] = value
                out = self.table[at, columns]
        rare = np.flatnonzero(columns < 0)
        for k in rare.tolist():
            key = (int(at[k]), int(codes[k]))
            if key not in self.rare:
                self.rare[key] = self.step(key[0], chr(key[1]))
            out[k] = self.rare[key]
        return out

    def columns_for(self, codes: np.ndarray) -> np.ndarray:
        cols = self.column_of[codes]
        if (cols < 0).any() and len(self.columns) < COLUMNS - 1:
            found, n = np.unique(codes[cols < 0], return_counts=True)
            for c in found[np.argsort(-n, kind="stable")].tolist():
                if len(self.columns) == COLUMNS - 1:
                    break
                self.columns[c] = self.column_of[c] = len(self.columns) + 1
            cols = self.column_of[codes]
        return cols

    def run(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From states `at`, over codes[begin:end] each: the states reached and the tokens counted."""
        order = np.argsort(begin - end, kind="stable")
        begin, lengths = begin[order], (end - begin)[order]
        state, count = at[order].astype(np.int64), np.zeros(len(at), np.int64)
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0]) if len(lengths) else 0), "right")
        for k, n in enumerate(active.tolist()):
            c = codes[begin[:n] + k]
            e = self.entries(state[:n], c, self.columns_for(c))
            state[:n] = e >> _SHIFT
            count[:n] += (e & ((1 << _SHIFT) - 1)) - _BIAS
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def long_stretch(self, codes: np.ndarray, begin: int, end: int) -> int:
        """Tokens of a stretch without a place to cut: chunk maps, composed."""
        first = np.arange(begin, end, LANE)
        last = np.minimum(first + LANE, end)
        guess, _ = self.run(codes, np.maximum(first - WARM_UP, begin), first, np.zeros(len(first), np.int64))
        guess[0] = 0
        after, count = self.run(codes, first, last, guess)
        while True:  # the prefix scan: a chunk's map is known at one state; where the scan enters another, it is found there
            wrong = np.flatnonzero(after[:-1] != guess[1:]) + 1
            if not len(wrong):
                return int(count.sum())
            guess[wrong] = after[wrong - 1]
            after[wrong], count[wrong] = self.run(codes, first[wrong], last[wrong], guess[wrong])

    def count(self, docs: list[bytes]) -> np.ndarray:
        if len(self.states) > STATES or len(self.rare) > 500_000:
            self.clear()
        prefixed = "".join(SPACE + d.decode() if d else "" for d in docs).replace(" ", SPACE)
        codes = np.frombuffer(prefixed.encode("utf-32-le"), np.uint32).astype(np.int64)
        self.columns_for(codes)
        n_chars = np.array([len(d.decode()) + 1 if d else 0 for d in docs], np.int64)
        stops = np.cumsum(n_chars)
        starts = stops - n_chars
        full = np.flatnonzero(n_chars)
        if not len(full):
            return np.zeros(len(docs), np.int64)
        # Places to cut: where texts begin, and spaces after other characters, about every LANE characters.
        cut = np.zeros(len(codes), bool)
        if self.pieces.cut_at_space:
            space = codes == ord(SPACE)
            places = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            cut[places[np.flatnonzero(np.diff(places // LANE, prepend=-1))]] = True
        cut[starts[full]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(codes))
        counts = np.zeros(len(begin), np.int64)
        short = end - begin <= 8 * LANE
        if short.any():
            _, counts[short] = self.run(codes, begin[short], end[short], np.zeros(int(short.sum()), np.int64))
        for k in np.flatnonzero(~short):
            counts[k] = self.long_stretch(codes, int(begin[k]), int(end[k]))
        total = np.concatenate(([0], np.cumsum(counts)))
        return total[np.searchsorted(begin, stops)] - total[np.searchsorted(begin, starts)]


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each worker process, which keeps what it has compiled."""
    if path not in _compiled:
        _compiled[path] = Transducer(Pieces(path))
    return _compiled[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of docs(doc_id, text)."""

    def count(batches):
        t = transducer(model_path)
        for batch in batches:
            sizes, tokens, held, size = [], [], [], 0
            for text in texts(batch):
                sizes.append(len(text))
                held.append(text)
                size += len(text)
                if size >= CHUNK:
                    tokens.append(t.count(held))
                    held, size = [], 0
            tokens.append(t.count(held))
            n = np.concatenate(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = small_batches(docs).selectExpr("cast(doc_id as long) as doc_id", "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
