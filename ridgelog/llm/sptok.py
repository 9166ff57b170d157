"""SentencePiece models rebuilt for the Tokenizers library: batch encoding and decoding of whole texts."""

import json
import os
import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from ridgelog.llm.common import runs

SPACE = "▁"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
# Fixed values of the model format: kinds of pieces, kinds of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: bytes of text that are encoded at once
RUN_BYTES = 1 << 20
#: words whose ids a task remembers, how long they are at most, and how many the library gets at once
REMEMBERED, LONGEST_WORD, LEARNT = 150_000, 64, 2048
#: threads of the library in each Python worker; as many as the machine has cores, its own default, spend
#: a quarter more CPU time on waiting for each other where every core runs a worker
THREADS = 2
#: numbers that the memory of ids keeps room for behind a run with very long words
_IDS_KEPT = 1 << 22


@dataclass
class SentencePieceModel:
    """What a model file says: pieces with scores and kinds, the model's kind and the normaliser."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True
    space_suffix: bool = False


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """``(number, value)`` of every field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError("not a SentencePiece model")
        yield key >> 3, value


def parse_model(data: bytes) -> SentencePieceModel:
    """The model in a serialised ModelProto."""
    model = SentencePieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind, model.byte_fallback, model.unk_id = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0)
            model.space_suffix = bool(trainer.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze_spaces, model.escape_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return model


def _merges(model: SentencePieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces whose union is a piece, the best union first; of equal unions the one with the longest left piece.

    That order gives the segmentation of SentencePiece for runs of one character too.
    """
    ids = {p: k for k, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    merges = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL and len(piece) > 1:
            merges += [(-score, -k, ids[piece[:k]], piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
    merges.sort()
    return [(a, b) for _, _, _, a, b in merges]


def _apart(model: SentencePieceModel) -> bool:
    """Whether no piece has a space marker behind another character, so that words can be encoded one by one."""
    return all(SPACE not in piece.lstrip(SPACE) for piece, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


def build_tokenizer(model: SentencePieceModel) -> Tokenizer:
    """The model as a tokenizer: normaliser, space marker, scores or merges, byte fallback, decoder."""
    if model.space_suffix or not model.escape_spaces:
        raise ValueError("models with suffixed or plain spaces are not supported")
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    elif model.kind == BPE:
        vocabulary = {p: k for k, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, _merges(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    if _apart(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*"), "isolated")
    user = [p for p, _, kind in model.pieces if kind == USER_DEFINED]
    if user:
        tokenizer.add_tokens([AddedToken(p, normalized=True) for p in user])
    tokenizer.decoder = decoders.Sequence([*_decoding(), decoders.Strip(" ", 1, 0)] if model.dummy_prefix else _decoding())
    return tokenizer


def _decoding() -> list:
    return [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]


@lru_cache(maxsize=4)
def _loaded(serialised: str) -> Tokenizer:
    return Tokenizer.from_str(serialised)


@lru_cache(maxsize=1)
def _word_encoder(serialised: str) -> "WordEncoder":
    return WordEncoder(serialised)


def encode_texts(tokenizer: Tokenizer, texts: list[str | None]) -> list[list[int]]:
    """The ids of each text; the library spreads a batch over its threads."""
    return [e.ids for e in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def decode_ids(tokenizer: Tokenizer, ids: list[list[int]]) -> list[str]:
    """The text of each list of ids; what the normaliser changed stays changed."""
    return tokenizer.decode_batch(ids, skip_special_tokens=False)


class WordEncoder:
    """Encodes and decodes whole texts by their words, each different word once.

    That gives the ids of the whole text if the tokenizer's pre-tokenizer cuts at
    the space markers, which it does if no piece reaches over one. Words of up to LONGEST_WORD characters are
    remembered up to REMEMBERED, then the memory starts afresh; longer ones (texts without spaces are one
    word) are known for one run of texts only. So the memory is bounded in bytes.
    """

    def __init__(self, serialised: str):
        self.normaliser = Tokenizer.from_str(serialised).normalizer
        self.prefix = self.normaliser.normalize_str("a") == SPACE + "a"
        samples, mark = (" ", "  b", "Å\u00a0"), SPACE * self.prefix
        plain = all(self.normaliser.normalize_str(x) == mark + x.replace(" ", SPACE) for x in samples)
        self.only_marks = plain and "Precompiled" not in serialised[:20_000]
        self.words = Tokenizer.from_str(serialised)
        self.words.normalizer, self.words.pre_tokenizer = normalizers.Sequence([]), None
        # as in the whole tokenizer, but for the space at the start of a text, which is taken off the whole
        self.words.decoder = decoders.Sequence(_decoding())
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.back: list[str] = []
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(REMEMBERED + 1, np.int64)
        # whether a word is decoded to itself, its marks being spaces
        self.same = np.zeros(REMEMBERED + 1, bool)

    def _learn(self, words: list[str]) -> None:
        lists = [e.ids for e in self.words.encode_batch_fast(words, add_special_tokens=False)]
        first = len(self.number)
        self.number.update(zip(words, range(first, first + len(words))))
        back = self.words.decode_batch(lists, skip_special_tokens=False)
        self.back += back
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
        begins = self.start[first]
        for name, least in (("start", len(self.number) + 1), ("same", len(self.number) + 1), ("ids", int(begins) + len(ids))):
            if len(getattr(self, name)) < least:
                setattr(self, name, np.resize(getattr(self, name), 2 * least))
        self.start[first + 1 : first + 1 + len(words)] = begins + np.cumsum(sizes)
        self.ids[begins : begins + len(ids)] = ids
        self.same[first : first + len(words)] = [b == w.replace(SPACE, " ") for b, w in zip(back, words)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids in one array, where each text's begin and end in it, and the texts that the ids decode to.

        A text whose words all decode to themselves decodes to itself; the others are put together from their words' texts.
        """
        mark = SPACE if self.prefix else ""
        normal = [mark + t.replace(" ", SPACE) if t or not mark else t for t in texts] if self.only_marks else [self.normaliser.normalize_str(t) for t in texts]
        words = [_WORD.findall(t) for t in normal]
        if len(self.number) > REMEMBERED:
            self._forget()
        known = self.number
        new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in known]
        long = [w for w in new if len(w) > LONGEST_WORD]
        new = [w for w in new if len(w) <= LONGEST_WORD] if long else new
        for some in (new, long):
            for k in range(0, len(some), LEARNT):
                self._learn(some[k : k + LEARNT])
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        sizes = self.start[at + 1] - self.start[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.start[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        differ = np.concatenate([[0], np.cumsum(~self.same[at])])[bounds]
        back, decoded = self.back, list(texts)
        for k, (changed, t) in enumerate(zip(np.diff(differ).tolist(), texts)):
            if changed or not self.only_marks or SPACE in t:
                whole = "".join([back[j] for j in at[bounds[k] : bounds[k + 1]].tolist()])
                decoded[k] = whole[1:] if self.prefix and whole[:1] == " " else whole
        for w in long:
            del known[w]
        del back[len(known) :]
        if len(self.ids) > _IDS_KEPT:
            self.ids = self.ids[: max(1 << 16, int(self.start[len(known)]))].copy()
        return ids, ends[bounds], decoded


def differing_texts(model: bytes, texts: list[str]) -> list[str]:
    """The texts that SentencePiece itself encodes or decodes otherwise than the rebuilt tokenizer; none, if all is well."""
    import sentencepiece

    own, tokenizer = sentencepiece.SentencePieceProcessor(model_proto=model), build_tokenizer(parse_model(model))
    theirs, ours = own.encode(texts, num_threads=1), encode_texts(tokenizer, texts)
    decoded = zip(own.decode(theirs, num_threads=1), decode_ids(tokenizer, ours))
    return [t for t, a, b, (x, y) in zip(texts, theirs, ours, decoded) if a != b or x != y]


def read_model(path: str) -> bytes:
    """The bytes of a model file, read by the driver; a vocabulary, so a few megabytes at most."""
    with open(path, "rb") as file:
        return file.read()


def _use_threads(threads: int) -> None:
    """The library reads the number once, at its first batch in a process; a setting of the cluster's own stays."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))


def encode(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", threads: int = THREADS) -> DataFrame:
    """``(doc_id, ids, n_ids, exact)`` for every row: the whole text as ids of the model.

    Every text's ids are decoded again, and ``exact`` says whether that gives the text back, character by
    character. A null text is encoded like an empty one, into no ids, and is exact. Repeated
    rows and null doc_ids stay; other columns are not read. The serialised tokenizer,
    whose size is the vocabulary's, goes to every task; texts are encoded
    in runs of about RUN_BYTES bytes. Where pieces reach over spaces the library gets whole texts, else
    the different words of a run, on ``threads`` threads.
    """
    parsed = parse_model(model)
    serialised, by_word = build_tokenizer(parsed).to_str(), _apart(parsed) and not any(kind == USER_DEFINED for _, _, kind in parsed.pieces)

    def encoded(batches):
        _use_threads(threads)
        for batch in batches:
            for start, stop in runs(batch.column(1), RUN_BYTES):
                part = batch.slice(start, stop - start)
                texts = [t or "" for t in part.column(1).to_pylist()]
                if by_word:
                    ids, ends, back = _word_encoder(serialised).encode(texts)
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                else:
                    found = encode_texts(_loaded(serialised), texts)
                    back, lists = decode_ids(_loaded(serialised), found), pa.array(found, pa.list_(pa.int32()))
                exact = np.array([a == b for a, b in zip(back, texts)], bool)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(exact)], ["doc_id", "ids", "exact"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(encoded, "doc_id long, ids array<int>, exact boolean")
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "exact")


def decode(rows: DataFrame, model: bytes, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with a column ``text`` decoded from ``ids``; null ids give a null text."""
    serialised = build_tokenizer(parse_model(model)).to_str()

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        _use_threads(THREADS)
        lists = ids.to_pylist()
        texts = decode_ids(_loaded(serialised), [x or [] for x in lists])
        return pa.array([None if x is None else t for x, t in zip(lists, texts)], pa.string())

    return rows.withColumn(text, decoded(F.col(ids)))
