"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search runs over a text's symbols (a space is the piece symbol U+2581, a dummy one
stands first) and maximises the sum of piece scores; among equal sums the segmentation
whose last piece is longer wins. It keeps a window of at most `longest piece` open
positions: whenever the backpointer paths of all open positions meet in one boundary,
the ids before it are committed and forgotten, so memory does not grow with the text.
A symbol outside the vocabulary costs ten less than the worst score and is written as
its UTF-8 bytes (byte pieces); a U+2581 of the text itself counts as such a symbol. So
decoding returns every text exactly.

No piece of the vocabulary holds U+2581 after another symbol (checked at load). So all
paths meet before each run of U+2581, and equal stretches between such boundaries have
equal ids. A bounded dictionary keeps their ids; emptying it changes no result.

Defined cases: a null or empty text has no ids (an empty array) and decodes to "";
repeated rows give equal results; other input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_of, tidied

SPACE = "▁"
#: Stands for a U+2581 of the text itself (no text holds a lone surrogate).
LITERAL = "\udc81"
#: Where the vocabulary lies by default; a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches whose ids a worker keeps.
CACHE = 200_000


class Vocabulary:
    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_id = [0] * 256
        self.best: dict[str, tuple[float, int]] = {}
        scores = []
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not special[i]:
                self.best[piece] = (sp.get_score(i), i)
                scores.append(sp.get_score(i))
        self.unknown = min(scores) - 10.0
        self.longest = max(map(len, self.best))
        #: The pieces and all their beginnings (id -1: no piece itself).
        self.tree = {p[:k]: (0.0, -1) for p in self.best for k in range(1, len(p))} | self.best
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.best)
        of_bytes = {i: k for k, i in enumerate(self.byte_id)}
        self.raw = [bytes([of_bytes[i]]) if i in of_bytes else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.cache: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        self.arrays = None


_loaded: dict[str, Vocabulary] = {}


def vocabulary(model_file: str = MODEL) -> Vocabulary:
    if model_file not in _loaded:
        _loaded[model_file] = Vocabulary(model_file)
    return _loaded[model_file]


def viterbi(symbols: str, v: Vocabulary) -> Iterator[list[int]]:
    """Ids of the best segmentation, given out in runs as soon as they are certain."""
    tree, unknown, n, base, reach = v.tree, v.unknown, len(symbols), 0, 0
    score = [0.0]  # of the positions base, base+1, ...
    back: list[tuple[int, int]] = [(0, -1)]  # start of the last piece, its id (-1: bytes)
    grow = v.longest + 1
    for i in range(n):
        at = i - base
        if len(score) < at + grow:
            score += [-1e300] * grow
            back += [(0, -1)] * grow
        s, j, known = score[at], i, False
        while j < n:
            j += 1
            hit = tree.get(symbols[i:j])
            if hit is None:
                break
            if hit[1] >= 0:
                known |= j == i + 1
                if s + hit[0] > score[j - base]:
                    score[j - base] = s + hit[0]
                    back[j - base] = (i, hit[1])
                if j > reach:
                    reach = j
        if not known:
            if s + unknown > score[at + 1]:
                score[at + 1] = s + unknown
                back[at + 1] = (i, -1)
            if reach <= i:
                reach = i + 1
        meet = i + 1
        if meet != reach:
            if meet - base < 4 * grow:
                continue
            # The open paths are followed back to where they meet.
            open_at = {p for p in range(meet, reach + 1) if score[p - base] > -1e300}
            while len(open_at) > 1:
                far = max(open_at)
                open_at.discard(far)
                open_at.add(back[far - base][0])
            meet = open_at.pop()
        if meet > base:
            yield _ids(symbols, back, base, meet, v)
            del score[: meet - base], back[: meet - base]
            base = meet


def _ids(symbols: str, back: list[tuple[int, int]], base: int, p: int, v: Vocabulary) -> list[int]:
    out: list[int] = []
    while p > base:
        start, piece = back[p - base]
        if piece >= 0:
            out.append(piece)
        else:
            out += [v.byte_id[b] for b in reversed(symbols[start:p].replace(LITERAL, SPACE).encode())]
        p = start
    return out[::-1]


def whole(symbols: str, v: Vocabulary) -> list[int]:
    """The same search over a short stretch, kept whole."""
    get, unknown, n = v.tree.get, v.unknown, len(symbols)
    score, back = [0.0] + [-1e300] * n, [(0, -1)] * (n + 1)
    for i in range(n):
        s, known = score[i], False
        for j in range(i + 1, n + 1):
            hit = get(symbols[i:j])
            if hit is None:
                break
            if hit[1] >= 0:
                if j == i + 1:
                    known = True
                t = s + hit[0]
                if t > score[j]:
                    score[j] = t
                    back[j] = (i, hit[1])
        if not known and s + unknown > score[i + 1]:
            score[i + 1] = s + unknown
            back[i + 1] = (i, -1)
    return _ids(symbols, back, 0, n, v)


def _edges(v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree as arrays: sorted edge keys (node << 21 | code point), the nodes they lead
    to, and each node's score and id (-1: no piece ends here)."""
    if v.arrays is None:
        number = {"": 0} | {p: i + 1 for i, p in enumerate(v.tree)}
        keys = np.array([(number[p[:-1]] << 21) | ord(p[-1]) for p in v.tree], np.int64)
        order = np.argsort(keys)
        score = np.array([0.0, *[x[0] for x in v.tree.values()]])
        ids = np.array([-1, *[x[1] for x in v.tree.values()]], np.int64)
        v.arrays = keys[order], np.arange(1, len(keys) + 1)[order], score, ids
    return v.arrays


def _solve(stretches: list[str], v: Vocabulary) -> Iterator[tuple[str, bytes]]:
    """`whole` for many stretches of one length at once."""
    keys, leads, node_score, node_id = _edges(v)
    n, many = len(stretches[0]), len(stretches)
    chars = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(many, n).astype(np.int64)
    score = np.full((n + 1, many), -1e300)
    score[0] = 0
    back = np.zeros((n + 1, many), np.int64)
    piece = np.full((n + 1, many), -1, np.int64)
    for i in range(n):
        row, node, known = np.arange(many), np.zeros(many, np.int64), np.zeros(many, bool)
        for j in range(i + 1, n + 1):
            key = (node << 21) | chars[row, j - 1]
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            hit = keys[at] == key
            if not hit.any():
                break
            row, node = row[hit], leads[at[hit]]
            here = node_id[node] >= 0
            if j == i + 1:
                known[row[here]] = True
            better = here & (score[i, row] + node_score[node] > score[j, row])
            r = row[better]
            score[j, r] = score[i, r] + node_score[node[better]]
            back[j, r] = i
            piece[j, r] = node_id[node[better]]
        r = np.flatnonzero(~known & (score[i] + v.unknown > score[i + 1]))
        score[i + 1, r] = score[i, r] + v.unknown
        back[i + 1, r] = i
        piece[i + 1, r] = np.where(chars[r, i] < 128, np.array(v.byte_id)[np.minimum(chars[r, i], 127)], -1)
    ids = np.full((many, n), -1, "<i4")
    pos, size, odd = np.full(many, n), np.zeros(many, np.int64), np.zeros(many, bool)
    while True:
        r = np.flatnonzero(pos > 0)
        if not len(r):
            break
        got = piece[pos[r], r]
        odd[r] |= got < 0
        size[r] += 1
        ids[r, n - size[r]] = got
        pos[r] = back[pos[r], r]
    flat = ids.tobytes()
    for k, (stretch, m, strange) in enumerate(zip(stretches, size.tolist(), odd.tolist(), strict=True)):
        end = 4 * n * (k + 1)
        yield stretch, np.array(whole(stretch, v), "<i4").tobytes() if strange else flat[end - 4 * m : end]


_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def encode_many(texts: list[str], v: Vocabulary) -> list[tuple[bytes, bool]]:
    """For each text its ids as little-endian 32-bit integers, and whether they decode to
    it. Both hold for a text because they hold for each of its stretches."""
    if not v.cuts:
        out = []
        for t in texts:
            symbols = SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE)
            ids = np.array([i for run in viterbi(symbols, v) for i in run] if t else [], "<i4")
            out.append((ids.tobytes(), decode(ids.tolist(), v) == t))
        return out
    find, cache = _STRETCH.findall, v.cache
    parts = [find(SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE)) if t else [] for t in texts]
    by_length: dict[int, list[str]] = {}
    for stretch in set().union(*parts).difference(cache):
        by_length.setdefault(len(stretch), []).append(stretch)
    local: dict[str, bytes] = {}
    for n, group in by_length.items():
        if n > 64:
            local.update((x, np.array([i for run in viterbi(x, v) for i in run], "<i4").tobytes()) for x in group)
        else:
            for k in range(0, len(group), 20_000):
                cache.update(_solve(group[k : k + 20_000], v))
    raw = v.raw
    wrong = set()
    for found, keys in ((local, local), (cache, [x for n, g in by_length.items() if n <= 64 for x in g])):
        for stretch in keys:
            said = b"".join([raw[i] for i in np.frombuffer(found[stretch], "<i4").tolist()])
            if said != stretch.replace(SPACE, " ").replace(LITERAL, SPACE).encode():
                wrong.add(stretch)
    v.wrong |= wrong
    get = (lambda x: local[x] if x in local else cache[x]) if local else cache.__getitem__
    out = [(b"".join(map(get, p)), not v.wrong or v.wrong.isdisjoint(p)) for p in parts]
    if len(cache) > CACHE:
        cache.clear()
    return out


def encode(text: str, v: Vocabulary) -> bytes:
    """Ids of a text as little-endian 32-bit integers."""
    return encode_many([text], v)[0][0]


def decode(ids, v: Vocabulary) -> str:
    """The text of ids; the dummy first space goes."""
    raw = v.raw
    said = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
    return said[1:] if said.startswith(" ") else said


def encode_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model_file: str = MODEL) -> DataFrame:
    """Rows (id, n_chars, n_ids, ids, exact), one per input row. `exact`: the ids,
    decoded again, are the text."""
    source = text_of(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)

        def made(keys, parts, chars, exact):
            sizes = np.array([len(p) // 4 for p in parts], np.int64)
            ids = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [keys, pa.array(chars, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(offsets, ids), pa.array(exact, pa.bool_())], names=["id", "n_chars", "n_ids", "ids", "exact"]
            )

        for b in batches:
            for lo, hi, _, _ in chunks(b.column(1), 4_000_000):
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                coded = encode_many(texts, v)
                yield made(b.column(0).slice(lo, hi - lo), [x for x, _ in coded], list(map(len, texts)), [x for _, x in coded])
        v.cache.clear()

    of = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(tidied(run), f"id {of}, n_chars bigint, n_ids bigint, ids array<int>, exact boolean")


def decode_ids(encoded: DataFrame, id_column: str = "id", ids_column: str = "ids", model_file: str = MODEL) -> DataFrame:
    """Rows (id, text) from rows with ids. Null ids give an empty text."""
    source = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for b in batches:
            texts = [decode(x or [], v) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    of = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(tidied(run), f"id {of}, text string")
