"""Operator 8: flat token-ID files with 64-bit document offsets.

Rows are range-partitioned and sorted by id; each partition streams its ids to one flat file of unsigned integers (16
bits wide where the vocabulary allows it), next to the cumulative end offsets of its documents (unsigned 64-bit) and
their ids (signed 64-bit). The manifest, one row for each partition that was committed, gets every partition's base by
a prefix sum over the partitions' token counts. Readers memory-map the files. A task that is run again writes files of
a new name; only those whose rows reach the checkpointed manifest are ever read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodechain.llm.common import AT_ONCE, gathered, runs, sums, trimmed
from lodechain.session import cut, shared_dir

#: Words that a Python worker remembers before it starts anew, and the longest of them.
CACHE_ENTRIES = 600_000
LONGEST = 48
#: Stands for a null id in the files.
NO_ID = -(1 << 63)
MANIFEST = "part int, stem string, dtype string, n_docs long, n_tokens long"

#: The normaliser, pre-tokenizer and model of tokenizers whose texts may be encoded word by word.
BY_WORDS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "BPE", "</w>",
]

_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_ENDS = ".,;:!?)]}%&$#*"


class WordCache:
    """Ids of texts by way of their space-separated words, each encoded once by the tokenizer.

    Only right for a tokenizer that drops white space, lower-cases and never joins across white space, so ``BY_WORDS`` says
    which; with any other the texts are encoded whole. Words are split further at ASCII class borders, as the
    tokenizer's own pre-tokenizer does, so that "word," and "word" share an entry.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {"": b""}
        last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            last[i] = token.endswith("</w>")
        self.last = last
        made = json.loads(self.tokenizer.to_str())
        self.by_words = [made["normalizer"], made["pre_tokenizer"], made["model"]["type"], made["model"].get("end_of_word_suffix")] == BY_WORDS

    def _run(self, pieces: list[str]) -> None:
        """Encode new pieces, joined by spaces; the vocabulary marks the last token of each pre-token, which tells them
        apart. Where the count shows that a piece holds several, each is encoded by itself."""
        for lo in range(0, len(pieces), 2000):
            part = pieces[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize
            raw = ids.tobytes()
            if len(ends) == len(part) and len(raw) == ends[-1]:
                at = 0
                for piece, e in zip(part, ends.tolist(), strict=True):
                    self.words[piece] = raw[at:e]
                    at = e
            else:
                for piece in part:
                    self.words[piece] = self._alone(piece)

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    @staticmethod
    def _pieces(word: str) -> list[str]:
        if word.isascii():
            return _ASCII.findall(word.lower())
        core = word.rstrip(_ENDS)
        return [core, word[len(core) :]] if core and core != word and core[-1].lower().isalpha() else [word]

    def _learn(self, missing: list[str]) -> list[str]:
        """Encode words that are not remembered; gives those that are not to stay."""
        whole, pieces = [], {}
        for w in missing:
            if "<|" in w or len(w) > LONGEST:
                whole.append(w)
            else:
                pieces[w] = self._pieces(w)
        new = {p for ps in pieces.values() for p in ps}.difference(self.words)
        single = [p for p in new if p.isascii() or p.isalpha()]
        self._run(single)
        for p in new.difference(single):
            self.words[p] = self._alone(p)
        for w, ps in pieces.items():
            self.words[w] = self.words[ps[0]] if len(ps) == 1 else b"".join([self.words[p] for p in ps])
        for w in whole:
            self.words[w] = self._alone(w)
        return whole

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, one behind the other, and how many each has."""
        if not self.by_words:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return np.array(list(chain.from_iterable(f.ids for f in found)), self.dtype), np.array([len(f.ids) for f in found], np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        lowered = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words)).dictionary_encode()
        keys = lowered.dictionary.to_pylist()
        if len(self.words) > CACHE_ENTRIES:
            self.words = {"": b""}
        passing = self._learn([k for k in keys if k not in self.words])
        cells = list(map(self.words.__getitem__, keys))
        for w in passing:
            del self.words[w]
        length = np.fromiter(map(len, cells), np.int64, len(cells)) // self.dtype.itemsize
        index = lowered.indices.to_numpy()[coded.indices.to_numpy()]
        ids = gathered(np.frombuffer(b"".join(cells), self.dtype), np.cumsum(length) - length, length, index)
        return ids, sums(length[index], pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))


@lru_cache(maxsize=2)
def encoder(vocab: str) -> WordCache:
    return WordCache(vocab if "/" in vocab else public_tokenizers.path(vocab))


def write(df: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", vocab: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Write the ids of every whole text in ascending ``doc_id`` order and return the manifest with ``base``.

    A null or empty text has no ids but the end id; null ids come first; equal ids are ordered by their texts' hashes and
    repeated rows each have a place. An empty table gives an empty manifest and no files; other columns are not read.
    ``AT_ONCE`` bytes of text are encoded at once, or one text where it is longer.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocab), TaskContext.get().partitionId()
        stem = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        fs, path = pyarrow.fs.FileSystem.from_uri(stem)
        at, n, out = 0, 0, None
        for b in batches:
            for lo, hi in runs(b.column(1), AT_ONCE):
                if out is None:
                    out = [fs.open_output_stream(f"{path}.{x}") for x in ("ids", "off", "doc")]
                ids, counts = enc.encode(b.column(1)[lo:hi])
                ends = np.cumsum(counts)
                out[0].write(np.insert(ids, ends, end_id).tobytes())
                ends += np.arange(1, len(ends) + 1)
                out[1].write((at + ends).astype("<u8").tobytes())
                out[2].write(b.column(0)[lo:hi].fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
                at += int(ends[-1])
                n += hi - lo
        if out is not None:
            for f in out:
                f.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "stem": stem, "dtype": enc.dtype.str, "n_docs": n, "n_tokens": at}], pa.schema([("part", pa.int32()), ("stem", pa.string()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    shared_dir(spark)
    parts = sorted(cut(ordered.mapInArrow(trimmed(run), MANIFEST)).collect())
    bases = np.cumsum([0] + [p.n_tokens for p in parts])
    manifest = [(*p, int(b)) for p, b in zip(parts, bases, strict=False)]
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps([dict(zip(("part", "stem", "dtype", "n_docs", "n_tokens", "base"), m, strict=True)) for m in manifest]).encode())
    return spark.createDataFrame(manifest, MANIFEST + ", base long")


def read(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files a manifest names: doc_id, start (ids before it in all files), n_tokens, ids_crc32 (of the
    ids as 32-bit integers) and, on demand, the ids as packed 32-bit integers."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def column(stem: str, kind: str, dtype: str) -> np.ndarray:
        fs, path = pyarrow.fs.FileSystem.from_uri(f"{stem}.{kind}")
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            return np.memmap(path, dtype, "r")
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.to_pylist():
                ids, ends, docs = column(m["stem"], "ids", m["dtype"]), column(m["stem"], "off", "<u8"), column(m["stem"], "doc", "<i8")
                for lo in range(0, len(ends), 4096):
                    e = ends[lo : lo + 4096].astype(np.int64)
                    s = np.concatenate([[int(ends[lo - 1]) if lo else 0], e[:-1]])
                    raw = [ids[i:j].astype("<u4").tobytes() for i, j in zip(s, e, strict=True)]
                    k = docs[lo : lo + 4096]
                    made = [pa.array(k, pa.int64(), mask=k == NO_ID), pa.array(s + m["base"]), pa.array(e - s), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                    yield pa.RecordBatch.from_arrays(made + [pa.array(raw, pa.binary())] * with_ids, schema=pa.schema(fields))

    spread = manifest.repartition(max(1, manifest.count()), "stem")
    return spread.mapInArrow(trimmed(run), schema)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, made on the file system that its URI names."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = re.sub(r"^file:/+", "file:///", folder)
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return folder
