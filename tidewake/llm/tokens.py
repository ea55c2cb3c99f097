"""Token ids of whole texts, with a public tokenizer whose file is a parameter."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"
CACHED_CHUNKS = 450_000
MARKS = "!#$%&*+,-./:;=?@^_~)]}"
PARTING = "\x01"
"""A character that parts chunks which are encoded as one text; a chunk that holds it is encoded alone."""

_MARK, _LETTER, _GAP = (np.isin(np.arange(256), list(x)) for x in (MARKS.encode(), b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b" \n"))
_PLAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
"""What comes before the model where a word of Latin-1's small letters reaches it as its bytes, in one piece."""
MANY_WORDS = 256
"""New words from which on plain ones pass the model alone; fewer go through the whole tokenizer."""
GROUP_CHARS = 8_000_000
"""Characters of texts whose chunks are told apart together; a text is not split."""

_shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b != 0xAD]
_BYTE_LETTERS = np.arange(256, dtype="<u4")
_BYTE_LETTERS[[b for b in range(256) if b not in _shown]] = 256 + np.arange(256 - len(_shown))
_BYTE_LETTERS[32] = 32

_open: dict[tuple[str, int], WordEncoder] = {}


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts chunk by chunk, the chunks being what spaces and line feeds part, and keeps the ids of the chunks.

    Right for tokenizers that drop white space before they split and never look across it, which holds for the
    word-end BPE used here; the tests compare it with the library's result for whole texts.  It keeps the ids of at most
    2 * cached chunks: when the newer half is full, the older half, less what was used since, is dropped.
    """

    def __init__(self, path: str, cached: int = CACHED_CHUNKS):
        self.cached = cached
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.width = 2 if self.tokenizer.get_vocab_size(True) <= 1 << 16 else 4
        """Bytes of an id as it is kept."""
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.lower() for t in added]
        alone = self.tokenizer.encode(PARTING, add_special_tokens=False).ids
        self.parting = alone[0] if len(alone) == 1 else None
        self.model, self.ends = None, None
        self._look_at(json.loads(self.tokenizer.to_str()))

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """For each text its ids and end_id, as little-endian unsigned 32-bit integers; a null text is empty."""
        return [np.frombuffer(x, f"<u{self.width}").astype("<u4").tobytes() for x in self.encode_narrow(texts, end_id)]

    def encode_narrow(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """The same, ``width`` bytes an id."""
        end = int(end_id).to_bytes(self.width, "little")
        return [ids for group in _groups(texts) for ids in self._encoded(group, end)]

    def _encoded(self, texts: list[str | None], end: bytes) -> list[bytes]:
        """One look-up a different chunk of these texts; Arrow parts the texts and strings the chunks' ids together."""
        data = _marks_apart(np.frombuffer("\n".join(self._folded(t or "").replace("\n", " ") for t in texts).encode(), np.uint8))
        gaps = data[np.flatnonzero((data == 32) | (data == 10))]
        bounds = np.concatenate([[0], np.flatnonzero(gaps == 10) + 1, [len(gaps) + 1]])  # the first chunk of each text
        data = np.where(data == 10, np.uint8(32), data)
        whole = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data))
        chunks = pc.split_pattern(whole, " ").flatten().dictionary_encode()
        kinds = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.new.get, kinds))
        if missing := [i for i, x in enumerate(found) if x is None]:
            self._learn({kinds[i] for i in missing})
            for i in missing:
                found[i] = self.new[kinds[i]]
        ids = pa.array(found, pa.large_binary()).take(chunks.indices)
        if len(self.new) > self.cached:
            self.new, self.old = {"": b""}, self.new
        _, at, data = ids.buffers()
        at = np.frombuffer(at, np.int64, len(ids) + 1)[bounds].tolist()
        data = memoryview(data) if data else b""
        return [b"".join((data[a:z], end)) for a, z in zip(at, at[1:])]

    def _look_at(self, parts: dict) -> None:
        """Sets ends: by id, whether the token ends a piece; None where that is not told by a suffix which any byte's token
        may have.  And model: the tokenizer without what comes before its model, if that changes no plain word."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        suffix = parts["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab(False)
        if not suffix or any(c + suffix not in vocab for c in ByteLevel.alphabet()):
            return
        self.ends = np.zeros(self.tokenizer.get_vocab_size(True) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        if all(parts[k] == v for k, v in _PLAIN.items()) and not parts["post_processor"]:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = WhitespaceSplit()

    def _folded(self, text: str) -> str:
        """Lower-cased where that changes no id, so that fewer chunks differ: the tokenizer lower-cases letter by letter,
        as Python does within Latin-1; but a special token's text must keep its case."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(s in low for s in self.special) else low

    def _learn(self, chunks: set[str]) -> None:
        new, old, code = self.new, self.old, "H" if self.width == 2 else "I"
        whole, both, heads, tails = set(), [], [], []
        for c in chunks:
            if c in old:
                new[c] = old.pop(c)
                continue
            head = c.rstrip(MARKS)
            if len(head) < len(c) and head[-1:].lower().isalpha():  # the marks behind a word are a piece of their own
                tail = c[len(head) :]
                both.append(c)
                heads.append(head)
                tails.append(tail)
                for x in (head, tail):
                    if x in old:
                        new[x] = old.pop(x)
                    elif x not in new:
                        whole.add(x)
            else:
                whole.add(c)
        single = list(whole)
        if self.ends is not None:  # words of letters are a piece each
            words = [c for c in single if c.isalpha()]
            single = [c for c in single if not c.isalpha()]
            if self.model is not None and len(words) >= MANY_WORDS:
                plain, others = [], []
                for c in words:
                    (plain if c.islower() and (c.isascii() or max(c) <= "\xff") else others).append(c)
                single += self._learn_words(plain, self.model, _byte_letters)
                words = others
            single += self._learn_words(words, self.tokenizer, lambda text: text)
        if self.parting is not None:  # many chunks pass as one text, parted by a piece of its own
            many = [c for c in single if PARTING not in c]
            single = [c for c in single if PARTING in c]
            for at in range(0, len(many), 4096):
                part = many[at : at + 4096]
                ids = np.array(self.tokenizer.encode_batch_fast([f" {PARTING} ".join(part)], add_special_tokens=False)[0].ids, f"<u{self.width}")
                ends = [*np.flatnonzero(ids == self.parting).tolist(), len(ids)]
                data, start = ids.tobytes(), 0
                for c, end in zip(part, ends, strict=True):
                    new[c] = data[start * self.width : end * self.width]
                    start = end + 1
        for at in range(0, len(single), 4096):
            part = single[at : at + 4096]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                new[c] = array(code, e.ids).tobytes()
        for c, head, tail in zip(both, heads, tails):
            new[c] = new[head] + new[tail]


    def _learn_words(self, words: list[str], tokenizer, written) -> list[str]:
        """Keeps the ids of words that are a piece each, which tokenizer finds in texts as ``written`` writes them; returns
        the words for which that failed."""
        failed = []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(tokenizer.encode_batch_fast([written(" ".join(part))], add_special_tokens=False)[0].ids, f"<u{self.width}")
            ends = np.flatnonzero(self.ends.take(ids)) + 1
            if len(ends) != len(part):
                failed += part
                continue
            data, start = ids.tobytes(), 0
            for c, end in zip(part, (ends * self.width).tolist()):
                self.new[c] = data[start:end]
                start = end
        return failed


def _byte_letters(text: str) -> str:
    """Each byte of the text but spaces as the letter that stands for it in a byte-level vocabulary."""
    return _BYTE_LETTERS.take(np.frombuffer(text.encode(), np.uint8)).tobytes().decode("utf-32-le")


def _marks_apart(data: np.ndarray) -> np.ndarray:
    """UTF-8 with a space before the marks that end a chunk behind a letter of ASCII: they are a piece of their own, and words
    with other marks behind them are the same word then."""
    mark = _MARK.take(data)
    after = np.flatnonzero(mark[1:] != mark[:-1]) + 1  # runs of marks and what is between them, from their beginnings
    after = np.concatenate([after, [len(data)]])
    if not len(data) or len(after) < 2:
        return data
    first = 0 if mark[after[0]] else 1
    starts, ends = after[first:-1:2], after[first + 1 :: 2]
    closed = (ends == len(data)) | _GAP.take(data.take(np.minimum(ends, len(data) - 1)))
    return np.insert(data, starts[closed & _LETTER.take(data.take(starts - 1))], 32)


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts, in order, in lists of about GROUP_CHARS characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "")
        if n >= GROUP_CHARS:
            yield held
            held, n = [], 0
    if held:
        yield held


def portions(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of 256 to 4,096 rows, about GROUP_CHARS bytes of the text column each."""
    size = batch.column(batch.schema.get_field_index(column)).nbytes
    rows = max(256, min(4096, batch.num_rows * GROUP_CHARS // max(1, size)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encoder(path: str, cached: int = CACHED_CHUNKS) -> WordEncoder:
    """This process's encoder for the file; the executors must find the file under the same path."""
    if (path, cached) not in _open:
        _open[path, cached] = WordEncoder(path, cached)
    return _open[path, cached]
