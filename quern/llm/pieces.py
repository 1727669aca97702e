"""SentencePiece encoding through a table of distinct marked words.

No piece of the model crosses from a word into the next word's whitespace marker, so each marked word is
segmented on its own. A block of texts is cut into marked words, each distinct one that the task's table lacks
is segmented once, and the ids are joined back by position.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quern.core import col
from quern.llm.batches import lists, release, slices, without

CHUNK = 1 << 20  # bytes of text whose words are held at a time
KEEP = 300_000  # words remembered in a task; only speed depends on it
SHORT = 64  # longer ones are forgotten after their block of texts
MARK = "▁"
MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@functools.lru_cache(maxsize=4)
def load(path: str) -> sentencepiece.SentencePieceProcessor:
    """The processor of a model file, refused if a piece can cross a whitespace marker."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(sp.get_piece_size()):
        if re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)):
            raise ValueError(f"piece {i} of {path} crosses a whitespace marker")
    if not sp.normalize("a").startswith(MARK):
        raise ValueError(f"{path} does not mark the first word")
    return sp


def segment(sp: sentencepiece.SentencePieceProcessor, marked: list[str]) -> list[list[int]]:
    """Ids of each marked word. The library adds the first marker itself, so it is taken off before."""
    found = sp.encode([m.replace(MARK, " ")[1:] for m in marked], num_threads=1)
    alone = sp.piece_to_id(MARK)
    return [[alone] if m == MARK else ids for m, ids in zip(marked, found, strict=True)]


def packed_ids(sp: sentencepiece.SentencePieceProcessor, texts: list[str | None], table: dict[str, bytes]) -> list[bytes]:
    """Ids of each text as 32-bit numbers end to end; `table` holds those of words met before and takes up the new ones."""
    cut = [MARKED.findall(sp.normalize(t)) if t else [] for t in texts]
    distinct = set(chain.from_iterable(cut))
    new = [w for w in distinct if w not in table]
    if len(table) + len(new) > KEEP:
        table.clear()
        new = list(distinct)
    table.update((w, array("i", ids).tobytes()) for w, ids in zip(new, segment(sp, new), strict=True))
    found = [b"".join(map(table.__getitem__, words)) for words in cut]
    for w in new:
        if len(w) > SHORT:
            del table[w]
    return found


def encode_texts(sp: sentencepiece.SentencePieceProcessor, texts: list[str | None]) -> list[list[int]]:
    """Ids of each text."""
    return [array("i", ids).tolist() for ids in packed_ids(sp, texts, {})]


def _encode(batches: Iterable[pa.RecordBatch], path: str, decode: bool) -> Iterator[pa.RecordBatch]:
    sp, table = load(path), {}
    for whole in batches:
        for batch in slices(whole, "_text", CHUNK):
            ids = packed_ids(sp, batch.column("_text").to_pylist(), table)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            made = {"ids": lists(np.frombuffer(b"".join(ids), np.int32), sizes)}
            if decode:
                made["decoded"] = pa.array([sp.decode(array("i", x).tolist()) if x else "" for x in ids], pa.string())
            rest = {f: c for f, c in zip(batch.schema.names, batch.columns, strict=True) if f != "_text"} | made
            yield pa.RecordBatch.from_arrays(list(rest.values()), names=list(rest))
    table.clear()
    release()


def encode(docs: DataFrame, model: str, text: str = "text", decode: bool = False) -> DataFrame:
    """Adds `ids`, the piece ids of every whole text without begin or end, and with `decode` the `decoded` text.

    The ids equal the library's for the whole text. A null or empty text has no ids and decodes to an empty text.
    Each task holds one block of texts and a bounded table of words. Input columns with the new names are replaced.
    """
    kept = without(docs, ["ids", "_text", *(["decoded"] if decode else [])])
    rows = docs.select(*[col(c) for c in kept.columns], col(text).cast("string").alias("_text"))
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    schema = ", ".join([*fields, "ids array<int>", *(["decoded string"] if decode else [])])
    return rows.mapInArrow(lambda batches: _encode(batches, model, decode), schema)
