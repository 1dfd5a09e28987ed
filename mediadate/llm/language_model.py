"""A word trigram model in Elias-Fano trie levels, memory-mapped by the scoring tasks.

Counts come from all training documents, and every n-gram is kept. Words are numbered by the order of
their hashes. Levels are cut into files, each written by a task of its own:

1. words, ``WIDTH`` a file: the hashes (monotone) and, by number, the count;
2. bigrams, at most ``ENTRIES`` a file: for word a, the following words b as a*V + b (monotone);
3. trigrams, at most ``ENTRIES`` a file: for bigram i, the third word as its rank among the followers
   of the bigram's second word, i*R + rank (monotone);
4. back-offs of bigrams, ``ENTRIES`` a file, by bigram;
5. heads of words, ``WIDTH`` a file: the first bigram (monotone) and the back-off of each word.

Bigrams are numbered through all files, so a file can end inside the followers of a word or of a bigram.
What a word or a bigram needs of all its followers is added up before files are cut. The driver holds
the first key and the first number of every file.

Probabilities are interpolated with absolute discounting: a context keeps the discounted mass as its
back-off weight, so they sum to one. They are stored as 16-bit codes of their logarithms.
"""

from __future__ import annotations

import itertools
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediadate.llm import elias_fano
from mediadate.llm.common import discard, file_system, settle, shared_folder, text_parts, worker_cache
from mediadate.llm.sharding import number_rows

END = b"\n"  # no word holds white space
WIDTH = 1 << 18
DISCOUNT = 0.75
ENTRIES = 1 << 20
CODES, LOWEST = 65_535, -24.0
WORDS_HELD = 500_000
TOKENS_HELD = 1 << 20
TEXT_BYTES = 1 << 22
# Parquet otherwise looks at the size of its pages and row groups every 100 rows
LONG_ROWS = {"parquet.block.size": 1 << 24, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
KEYS_HELD = 1 << 21
SAMPLES, RANGES = 64, 1 << 14
MAPPED_BYTES = 192 << 20


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    """True for documents of the fold; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _hashes(words: pa.Array) -> np.ndarray:
    """Signed, so that Spark and numpy order the hashes alike; the empty word stands for the end."""
    data = words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()).to_numpy(zero_copy_only=False)
    data[data == b""] = END
    return np.fromiter(map(xxhash.xxh64_intdigest, data), np.uint64, len(data)).view(np.int64)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of texts: codes of the tokens one after the other, the words that they stand for, tokens a text.

    A text ends with the empty word.
    """
    none, space = (pa.scalar(text, texts.type) for text in ("", " "))
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null(none)))
    # white space at the end makes an empty word, and so does an empty text
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, none), none, pc.binary_join_element_wise(trimmed, space, none)))
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, pc.list_value_length(lists).to_numpy().astype(np.int64)


def split_documents(docs: DataFrame) -> DataFrame:
    """Texts as codes of words, a row for some ``TEXT_BYTES`` of text: doc_id and held_out of its documents, their
    tokens' ``codes`` and number, and for each code the ``hashes`` of the words and the ``counts`` in training texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for part in text_parts(batch, TEXT_BYTES):
                codes, words, sizes = _tokens(part.column("text"))
                train = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool), sizes)
                counts = np.bincount(codes[train], minlength=len(words))
                hashes = _hashes(words)
                order = np.argsort(hashes)  # ascending ones are merged and found faster
                places = np.empty(len(order), "<i4")
                places[order] = np.arange(len(order))
                binaries = (sizes, places[codes], hashes[order], counts[order].astype("<i8"))
                whole = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(whole, part.column(name)) for name in ("doc_id", "held_out")]
                    + [pa.array([array.tobytes()], pa.binary()) for array in binaries],
                    ["doc_id", "held_out", "sizes", "codes", "hashes", "counts"],
                )

    schema = f"doc_id array<{kind}>, held_out array<boolean>, sizes binary, codes binary, hashes binary, counts binary"
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(work, schema)


def count_words(split: DataFrame) -> DataFrame:
    """``hash, count`` of the words of training texts; tasks add up what they have before the shuffle."""

    def flush(hashes, counts):
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts)], ["hash", "count"])

    def work(batches):
        held, size = [], 0
        for batch in batches:
            for hashes, counts in zip(*(column.to_pylist() for column in batch.columns)):
                hashes, counts = np.frombuffer(hashes, "<i8"), np.frombuffer(counts, "<i8")
                held.append((hashes[counts > 0], counts[counts > 0]))
                size += len(held[-1][0])
                if size > 2 * WORDS_HELD:
                    held = [_summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size > WORDS_HELD:
                        yield flush(*held[0])
                        held, size = [], 0
        if held:
            yield flush(*_summed(*map(np.concatenate, zip(*held))))

    rows = split.select("hashes", "counts").mapInArrow(work, "hash long, count long")
    return rows.groupBy("hash").agg(F.sum("count").alias("count"))


def _encode_log(values: np.ndarray) -> np.ndarray:
    scaled = np.rint((np.maximum(values, LOWEST) - LOWEST) / -LOWEST * CODES)
    return np.minimum(scaled, CODES).astype(np.uint16)


def _decode_log(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / CODES * -LOWEST + LOWEST


def _store(folder: str, level: int, shard: int, parts: dict[str, np.ndarray]) -> dict:
    """Write arrays one after the other, each at a multiple of 8 bytes; a row of the file list."""
    place = f"{folder}/{level}-{shard}-{uuid.uuid4().hex}"
    system, path = file_system(place)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    layout, at = [], 0
    with system.open_output_stream(path, compression=None) as out:
        for name, array in parts.items():
            data = array.tobytes()
            layout.append(f"{name}:{array.dtype.str}:{at}:{len(array)}")
            out.write(data + bytes(-len(data) % 8))
            at += len(data) + -len(data) % 8
    return {"level": level, "shard": shard, "place": place, "layout": ";".join(layout), "start": 0, "entries": 0}


FILES = "level long, shard long, place string, layout string, start long, entries long"


class Shard:
    """The arrays of one file, mapped from a local path or read from another store."""

    def __init__(self, place: str, layout: str):
        system, path = file_system(place)
        if system.type_name == "local":
            buffer = pa.memory_map(path).read_buffer()
        else:
            with system.open_input_file(path) as source:
                buffer = source.read_buffer()
        self.size, self.arrays = buffer.size, {}
        for part in layout.split(";"):
            name, kind, at, count = part.split(":")
            self.arrays[name] = np.frombuffer(buffer, kind, int(count), int(at))

    def sequence(self, name: str) -> elias_fano.EliasFano:
        prefix = f"{name}."
        return elias_fano.EliasFano({k.removeprefix(prefix): v for k, v in self.arrays.items() if k.startswith(prefix)})


def _named(name: str, parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{key}": array for key, array in parts.items()}


class Model:
    """The trie as far as it is built; a worker keeps the shards opened last, up to ``MAPPED_BYTES``."""

    def __init__(self, facts: dict, files: list[tuple]):
        self.vocabulary, self.total = facts["vocabulary"], facts["total"]
        self.relative = facts.get("relative", 1)
        self.firsts = np.array(facts["firsts"], np.int64)
        self.starts = {level: np.array(facts.get(f"starts{level}", []), np.int64) for level in (2, 3)}
        self.bases = {level: np.array(facts.get(f"bases{level}", []), np.int64) for level in (2, 5)}
        self.files = {(level, shard): (place, layout) for level, shard, place, layout in files}
        self.open = worker_cache().setdefault("model shards", OrderedDict())

    def shard(self, level: int, number: int) -> Shard | None:
        if (level, number) not in self.files:
            return None
        place = self.files[level, number]
        shard = self.open.pop(place, None)
        if shard is None:
            shard = Shard(*place)
            if level <= 3:
                shard.entries = shard.sequence("keys")
            if level == 5:
                shard.pointers = shard.sequence("pointers")
        self.open[place] = shard
        while len(self.open) > 1 and sum(held.size for held in self.open.values()) > MAPPED_BYTES:
            self.open.popitem(last=False)
        return shard

    @staticmethod
    def _by_shard(numbers: np.ndarray):
        if not len(numbers):
            return
        steps = np.diff(numbers)
        if (steps >= 0).all():
            order, ends = np.arange(len(numbers)), np.flatnonzero(steps) + 1
        else:
            # 16-bit numbers are sorted by radix, many times faster
            small = numbers.astype(np.uint16) if numbers.max() < 1 << 16 and numbers.min() >= 0 else numbers
            order = np.argsort(small, kind="stable")
            ends = np.flatnonzero(np.diff(small[order])) + 1
        for part in np.split(order, ends):
            if len(part):
                yield int(numbers[part[0]]), part

    def numbers_of(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes; -1 if unknown."""
        result = np.full(len(hashes), -1, np.int64)
        for number, part in self._by_shard(np.searchsorted(self.firsts, hashes, "right") - 1):
            if (shard := self.shard(1, number)) is not None:
                wanted = (hashes[part] - self.firsts[number]).view(np.uint64)
                inside = np.flatnonzero(wanted <= shard.arrays["span"][0])
                index, equal = shard.entries.find(wanted[inside])
                result[part[inside[equal]]] = index[equal] + number * WIDTH
        return result

    def of_words(self, name: str, words: np.ndarray, kind=np.float64, default=0) -> np.ndarray:
        result = np.full(len(words), default, kind)
        known = np.flatnonzero(words >= 0)
        for number, part in self._by_shard(words[known] // WIDTH):
            part = known[part]
            result[part] = self.shard(1, number).arrays[name][words[part] - number * WIDTH]
        return result

    def unigram(self, words: np.ndarray) -> np.ndarray:
        counts = self.of_words("counts", words)
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.vocabulary + 1)))

    def find(self, level: int, keys: np.ndarray):
        """Of the keys that are in the level: their places among ``keys``, shard and index in it."""
        for number, part in self._by_shard(np.searchsorted(self.starts[level], keys, "right") - 1):
            if number < 0:
                continue
            shard = self.shard(level, number)
            wanted = (keys[part] - self.starts[level][number]).view(np.uint64)
            inside = np.flatnonzero(wanted <= shard.arrays["span"][0])
            index, equal = shard.entries.find(wanted[inside])
            yield part[inside[equal]], number, index[equal]

    def bigrams_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Number of each bigram; -1 if there is none."""
        result = np.full(len(first), -1, np.int64)
        known = np.flatnonzero((first >= 0) & (second >= 0))
        for part, number, index in self.find(2, first[known] * self.vocabulary + second[known]):
            result[known[part]] = index + self.bases[2][number]
        return result

    def heads(self, words: np.ndarray) -> np.ndarray:
        """Number of the first bigram of each word; neighbors that are equal are looked up once."""
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
        distinct = words[first]
        result = np.zeros(len(distinct), np.int64)
        for number, part in self._by_shard(distinct // WIDTH):
            result[part] = self.shard(5, number).pointers.get(distinct[part] - number * WIDTH).astype(np.int64) + self.bases[5][number]
        return np.repeat(result, np.diff(first, append=len(words)))

    def word_backoffs(self, words: np.ndarray) -> np.ndarray:
        result = np.zeros(len(words))
        for number, part in self._by_shard(words // WIDTH):
            result[part] = _decode_log(self.shard(5, number).arrays["backoffs"][words[part] - number * WIDTH])
        return result

    def _bigram_shards(self, index: np.ndarray):
        for number, part in self._by_shard(np.searchsorted(self.bases[2], index, "right") - 1):
            yield self.shard(2, number), number, part, index[part] - self.bases[2][number]

    def of_bigrams(self, name: str, index: np.ndarray) -> np.ndarray:
        result = np.zeros(len(index))
        for shard, _, part, local in self._bigram_shards(index):
            values = shard.arrays[name][local]
            result[part] = values if name == "counts" else _decode_log(values)
        return result

    def second_words(self, index: np.ndarray) -> np.ndarray:
        result = np.zeros(len(index), np.int64)
        for shard, number, part, local in self._bigram_shards(index):
            result[part] = (shard.entries.get(local).astype(np.int64) + self.starts[2][number]) % self.vocabulary
        return result

    def bigram_backoffs(self, index: np.ndarray) -> np.ndarray:
        """Logarithms; a bigram that nothing follows has weight one."""
        result = np.zeros(len(index))
        for number, part in self._by_shard(index // ENTRIES):
            if (shard := self.shard(4, number)) is not None:
                result[part] = _decode_log(shard.arrays["backoffs"][index[part] - number * ENTRIES])
        return result

    def log_bigram(self, first: np.ndarray, second: np.ndarray, index: np.ndarray) -> np.ndarray:
        """log10 of the second word after the first; an unknown first word says nothing."""
        result = np.zeros(len(index))
        unknown = np.flatnonzero(index < 0)
        result[unknown] = self.unigram(second[unknown])
        missing = np.flatnonzero((index < 0) & (first >= 0))
        result[missing] += self.word_backoffs(first[missing])
        known = np.flatnonzero(index >= 0)
        result[known] = self.of_bigrams("codes", index[known])
        return result

    def pairs_of(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of neighbors in ascending order, and which of them each place has.

        Pairs repeat, and ascending ones are found in order of memory. Before a document's first
        token there is no word: -2.
        """
        first, second = words[:-1].copy(), words[1:]
        first[starts[starts > 0] - 1] = -2
        keys, places = np.unique((first + 2) << 32 | (second + 1), return_inverse=True)
        return (keys >> 32) - 2, (keys & 0xFFFFFFFF) - 1, places

    def bigram_facts(self, words: np.ndarray, starts: np.ndarray):
        """Distinct pairs, their places, numbers, ranks, and the places of trigrams' contexts."""
        first, second, places = self.pairs_of(words, starts)
        index = self.bigrams_of(first, second)
        known = index >= 0
        rank = np.zeros(len(index), np.int64)
        rank[known] = index[known] - self.heads(first[known])
        left, right = places[:-1], places[1:]
        context = np.flatnonzero(known[left] & (first[right] != -2))
        return first, second, places, index, known, rank, context

    def score(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 of every token; ``starts`` are the places where documents begin."""
        if len(words) < 2:
            return self.unigram(words)
        first, second, places, index, known, rank, context = self.bigram_facts(words, starts)
        result = np.concatenate([self.unigram(words[:1]), self.log_bigram(first, second, index)[places]])
        backoff = np.zeros(len(index))
        backoff[known] = self.bigram_backoffs(index[known])
        left, right = places[context], places[context + 1]
        result[context + 2] += backoff[left]
        both = np.flatnonzero(known[right])
        keys, back = np.unique(index[left[both]] * self.relative + rank[right[both]], return_inverse=True)
        chance, found = np.zeros(len(keys)), np.zeros(len(keys), bool)
        for part, number, at in self.find(3, keys):
            chance[part] = _decode_log(self.shard(3, number).arrays["codes"][at])
            found[part] = True
        there = found[back]
        result[context[both[there]] + 2] = chance[back[there]]
        return result

    def trigram_keys(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Key of every trigram; the bigrams of a training text are all in the trie."""
        _, _, places, index, known, rank, context = self.bigram_facts(words, starts)
        left, right = places[context], places[context + 1]
        both = known[right]
        return index[left[both]] * self.relative + rank[right[both]]


def encode_split(split: DataFrame, facts: dict, files: list[tuple]) -> DataFrame:
    """doc_id, held_out, the tokens' numbers, n_tokens, n_known and base_score of every document."""

    def work(batches):
        model = Model(facts, files)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                sizes, codes, hashes = (np.frombuffer(row.column(name)[0].as_py(), kind) for name, kind in (("sizes", "<i8"), ("codes", "<i4"), ("hashes", "<i8")))
                words = model.numbers_of(hashes)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                numbers = pa.py_buffer(words.astype("<i4")[codes])
                yield pa.RecordBatch.from_arrays(
                    [
                        row.column("doc_id").flatten(), row.column("held_out").flatten(),
                        pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, 4 * ends).astype("<i4")), numbers]),
                        pa.array(sizes), pa.array(np.add.reduceat((words >= 0).astype(np.int64)[codes], starts)),
                        pa.array(np.add.reduceat(model.unigram(words)[codes], starts)),
                    ],
                    ["doc_id", "held_out", "numbers", "n_tokens", "n_known", "base_score"],
                )

    kind = split.schema["doc_id"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, numbers binary, n_tokens long, n_known long, base_score double"
    return split.mapInArrow(work, schema)


def encode_corpus(docs: DataFrame, facts: dict, files: list[tuple]) -> DataFrame:
    """``encode_split`` of texts that are not split yet."""
    return encode_split(split_documents(docs), facts, files)


def _token_parts(batches):
    """Tokens of whole documents, some ``TOKENS_HELD`` at a time: rows, numbers, document starts."""
    for batch in batches:
        data = batch.column("numbers").to_pylist()
        sizes = np.array([len(one) // 4 for one in data], np.int64)
        begin = 0
        while begin < len(data):
            end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), TOKENS_HELD)))
            words = np.frombuffer(b"".join(data[begin:end]), "<i4").astype(np.int64)
            starts = np.cumsum(np.concatenate([[0], sizes[begin:end]]))[:-1]
            yield batch.slice(begin, end - begin), words, starts
            begin = end


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes, their bytes sorted by place."""
    planes = numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, 8 * count, "zstd", asbytes=True), np.uint8).reshape(8, count)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def _run_row(cell: int, keys: np.ndarray, counts: np.ndarray) -> dict:
    """A run of ascending keys and their counts."""
    return {"cell": cell, "entries": len(keys), "keys": _packed(np.diff(keys, prepend=0)), "counts": _packed(counts)}


def _run(entries: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unpacked(keys, entries)), _unpacked(counts, entries)


RUNS = "cell long, entries long, keys binary, counts binary"
RUN_SCHEMA = pa.schema([("cell", pa.int64()), ("entries", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of the columns; runs laid end to end are merged."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], *(np.add.reduceat(column[order], starts) if len(keys) else column for column in columns)


def bigram_keys(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    inside = np.ones(len(words), bool)
    inside[starts] = False  # no pair across documents
    return (words[:-1] << 32 | words[1:])[inside[1:]]


def _key_bounds(encoded: DataFrame, keys_of, total: int) -> np.ndarray:
    """First keys of the ranges but the lowest, from sampled places: some 2 * ``ENTRIES`` tokens a range.

    Ranges only decide which task merges which keys; the driver sorts ``SAMPLES`` keys a range, 2**20 in all.
    """
    ranges = min(RANGES, -(-total // (2 * ENTRIES)))
    if ranges < 2:
        return np.zeros(0, np.int64)
    step = max(1, total // (SAMPLES * ranges))

    def work(batches):
        keys = keys_of()
        for _, words, starts in _token_parts(batches):
            places = np.arange(step // 2, len(words), step)
            places = places[places - starts[np.searchsorted(starts, places, "right") - 1] >= 2]
            if len(places):
                windows = words[places[:, None] + np.arange(-2, 1)].reshape(-1)
                found = keys(windows, np.arange(len(places)) * 3)
                yield pa.RecordBatch.from_arrays([pa.array([found.astype("<i8").tobytes()], pa.binary())], ["keys"])

    rows = encoded.where("not held_out").select("numbers").mapInArrow(work, "keys binary").collect()
    keys = np.sort(np.frombuffer(b"".join(bytes(row["keys"]) for row in rows), "<i8"))
    return np.unique(keys[(np.arange(1, ranges) * len(keys)) // ranges]) if len(keys) else keys


def count_runs(encoded: DataFrame, keys_of, total: int) -> DataFrame:
    """The n-grams of the training texts as runs of at most ``ENTRIES`` distinct keys, written.

    ``keys_of`` gives a task the function from words and document starts to keys. Tasks count what they
    hold with numpy and send one run a range; the task of a range merges its runs. So n-grams are
    shuffled as compressed runs, none of them as a row.
    """
    bounds = _key_bounds(encoded, keys_of, total)

    def cut(held):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        ends = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
        rows = [_run_row(cell, keys[a:b], counts[a:b]) for cell, (a, b) in enumerate(itertools.pairwise(ends)) if b > a]
        return pa.RecordBatch.from_pylist(rows, RUN_SCHEMA)

    def count(batches):
        keys, held, size = keys_of(), [], 0
        for _, words, starts in _token_parts(batches):
            if len(words) > 1:
                held.append(keys(words, starts))
                size += len(held[-1])
            if size > KEYS_HELD:
                yield cut(held)
                held, size = [], 0
        if size:
            yield cut(held)

    def merge(batches):
        cell, held, size, least = 0, [], 0, KEYS_HELD
        for batch in batches:
            for cell, entries, keys, counts in zip(*(column.to_pylist() for column in batch.columns)):
                held.append(_run(entries, keys, counts))
                size += entries
                if size > 2 * least:
                    held = [_summed(*map(np.concatenate, zip(*held)))]
                    size = least = len(held[0][0])
                    least = max(least, KEYS_HELD)
        if held:
            keys, counts = _summed(*map(np.concatenate, zip(*held)))
            for k in range(0, len(keys), ENTRIES):
                yield pa.RecordBatch.from_pylist([_run_row(cell, keys[k : k + ENTRIES], counts[k : k + ENTRIES])], RUN_SCHEMA)

    rows = encoded.where("not held_out").select("numbers").mapInArrow(count, RUNS)
    dealt = rows.repartitionById(len(bounds) + 1, F.col("cell").cast("int"))
    return settle(dealt.mapInArrow(merge, RUNS))


def _group_sums(runs: DataFrame, divisor: int, width: int) -> DataFrame:
    """``shard, entries, groups, followers, n``: per group (key div divisor) how many keys and their counts, as runs a shard."""
    names = ["shard", "entries", "groups", "followers", "n"]

    def work(batches):
        for batch in batches:
            for _, entries, packed, counts in zip(*(column.to_pylist() for column in batch.columns)):
                keys, n = _run(entries, packed, counts)
                groups, followers, sums = _summed(keys // divisor, np.ones(len(keys), np.int64), n)
                ends = [0, *(np.flatnonzero(np.diff(groups // width)) + 1).tolist(), len(groups)]
                rows = [
                    (int(groups[a]) // width, b - a, _packed(np.diff(groups[a:b], prepend=0)), _packed(followers[a:b]), _packed(sums[a:b]))
                    for a, b in itertools.pairwise(ends)
                ]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)

    return runs.mapInArrow(work, "shard long, entries long, groups binary, followers binary, n binary")


def _build_sums(sums: DataFrame, build, shards: int) -> DataFrame:
    """Write the files of a level of groups, a task a shard; a group's parts are added up first."""

    def work(batches):
        def rows():
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns))

        for shard, own in itertools.groupby(rows(), key=lambda row: row[0]):
            parts = [(np.cumsum(_unpacked(groups, size)), _unpacked(followers, size), _unpacked(n, size)) for _, size, groups, followers, n in own]
            yield pa.RecordBatch.from_pylist([build(shard, *_summed(*map(np.concatenate, zip(*parts))))])

    return settle(sums.repartition(max(1, shards), "shard").sortWithinPartitions("shard").mapInArrow(work, FILES))


def _shard_rows(batches):
    """Whole shards of rows sorted by shard: its number and the other columns as arrays."""
    number, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
        ends = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), batch.num_rows]
        for begin, end in itertools.pairwise(ends):
            if number is not None and columns[0][begin] != number:
                yield int(number), [np.concatenate(parts) for parts in zip(*held)]
                held = []
            number = columns[0][begin]
            held.append([column[begin:end] for column in columns[1:]])
    if held:
        yield int(number), [np.concatenate(parts) for parts in zip(*held)]


def _build(rows: DataFrame, columns: list[str], build, shards: int) -> DataFrame:
    """Write the files of a level, a task a shard; result: the list of files."""

    def work(batches):
        for number, arrays in _shard_rows(batches):
            yield pa.RecordBatch.from_pylist([build(number, *arrays)])

    dealt = rows.repartition(max(1, shards), "shard").sortWithinPartitions("shard", columns[0])
    return settle(dealt.select(F.col("shard").cast("long"), *columns).mapInArrow(work, FILES))


def _build_runs(runs: DataFrame, build) -> DataFrame:
    """Write the files of a level, one for each run."""

    def work(batches):
        for batch in batches:
            for _, entries, keys, counts in zip(*(column.to_pylist() for column in batch.columns)):
                yield pa.RecordBatch.from_pylist([build(*_run(entries, keys, counts))])

    return settle(runs.mapInArrow(work, FILES))


def _ranges(table: DataFrame, level: int, facts: dict) -> list[tuple]:
    """Files of ranges in the order of their keys; their first keys and numbers go to ``facts``."""
    found = table.orderBy("start").collect()
    facts[f"starts{level}"] = [row["start"] for row in found]
    facts[f"last{level}"] = found[-1]["entries"] if found else 0
    facts[f"bases{level}"] = [0, *itertools.accumulate(row["entries"] for row in found)][: len(found)]
    return [(level, number, row["place"], row["layout"]) for number, row in enumerate(found)]


def _files(*tables: DataFrame) -> list[tuple]:
    """Shard files of levels, in the driver."""
    return [(row["level"], row["shard"], row["place"], row["layout"]) for table in tables for row in table.collect()]


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32 if counts.max() < 1 << 32 else np.int64)


def _range_store(folder: str):
    """A function that writes the file of a range: ascending keys from the first one on, and more arrays."""

    def store(level, keys, parts):
        values = (keys - keys[0]).view(np.uint64)
        parts = {"span": values[-1:]} | parts | _named("keys", elias_fano.encode(values, int(values[-1]) + 1, sampled=True))
        return _store(folder, level, 0, parts) | {"start": int(keys[0]), "entries": len(keys)}

    return store


class Builder:
    """Trains the model: fields ``facts`` and ``files`` grow with every level."""

    def __init__(self, docs: DataFrame):
        self.folder = shared_folder(docs.sparkSession)
        self.split = settle(split_documents(docs), **LONG_ROWS)
        words = settle(count_words(self.split))
        sums = words.agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("count").alias("total")).first()
        if sums["vocabulary"] >= 1 << 31:
            raise OverflowError("the words' numbers do not fit 31 bits")
        numbered = number_rows(words.select(F.lit(0).alias("shard"), "hash", "count"), ["hash"])
        numbered = settle(numbered.select((F.col("slot") / WIDTH).cast("long").alias("shard"), "hash", "count"))
        discard(words)
        firsts = numbered.groupBy("shard").agg(F.min("hash").alias("first")).orderBy("shard").collect()
        self.facts = {
            "vocabulary": sums["vocabulary"], "total": sums["total"] or 0, "firsts": [row["first"] for row in firsts],
        }
        self.shards = len(firsts)
        self.files = _files(self._words(numbered))

    def _words(self, numbered: DataFrame) -> DataFrame:
        folder, firsts = self.folder, self.facts["firsts"]

        def build(number, hashes, counts):
            values = (hashes - np.int64(firsts[number])).view(np.uint64)
            keys = elias_fano.encode(values, int(values[-1]) + 1)
            parts = {"span": values[-1:], "counts": counts.astype(np.int64)} | _named("keys", keys)
            return _store(folder, 1, number, parts)

        return _build(numbered, ["hash", "count"], build, self.shards)

    def add_bigrams(self, encoded: DataFrame) -> None:
        """Write level 5 from sums per first word, then level 2."""
        bigrams = count_runs(encoded, lambda: bigram_keys, self.facts["total"])
        folder, facts, files = self.folder, dict(self.facts), list(self.files)

        def build_heads(number, first, followers, counts):
            model, base = Model(facts, files), number * WIDTH
            width = min(WIDTH, facts["vocabulary"] - base)
            sizes, kept = np.zeros(width, np.int64), np.zeros(width)
            sizes[first - base] = followers
            kept[first - base] = counts - DISCOUNT * followers
            totals = model.of_words("counts", np.arange(base, base + width))
            starts = np.cumsum(sizes) - sizes
            total = int(sizes.sum())
            parts = {"backoffs": _encode_log(np.log10(1 - kept / np.maximum(totals, 1)))}
            parts |= _named("pointers", elias_fano.encode(starts, total + 1))
            return _store(folder, 5, number, parts) | {"entries": total, "start": int(sizes.max(initial=0))}

        # words without followers have heads too: every shard has a row at least, without groups
        none = F.lit(b"")
        every = encoded.sparkSession.range(self.shards).select(
            F.col("id").alias("shard"), F.lit(0).cast("long").alias("entries"), none.alias("groups"), none.alias("followers"), none.alias("n")
        )
        sums = _group_sums(bigrams, 1 << 32, WIDTH).unionByName(every)
        heads = _build_sums(sums, build_heads, self.shards).orderBy("shard").collect()
        self.facts["relative"] = max((row["start"] for row in heads), default=0) + 1
        self.facts["bases5"] = [0, *itertools.accumulate(row["entries"] for row in heads)][: len(heads)]
        self.files += [(5, row["shard"], row["place"], row["layout"]) for row in heads]
        facts, files, store = dict(self.facts), list(self.files), _range_store(folder)

        def build(pairs, counts):
            model = Model(facts, files)
            first, second = pairs >> 32, pairs & 0xFFFFFFFF
            words, back = np.unique(first, return_inverse=True)
            totals, backoff = model.of_words("counts", words), 10.0 ** model.word_backoffs(words)
            chance = (counts - DISCOUNT) / totals[back] + backoff[back] * 10.0 ** model.unigram(second)
            keys = first * facts["vocabulary"] + second
            return store(2, keys, {"counts": _narrow(counts), "codes": _encode_log(np.log10(chance))})

        self.files += _ranges(_build_runs(bigrams, build), 2, self.facts)
        discard(bigrams)

    def add_trigrams(self, encoded: DataFrame) -> None:
        """Write level 4 from sums per bigram, then level 3."""
        folder, facts, files = self.folder, dict(self.facts), list(self.files)
        bigrams = facts["bases2"][-1] + facts["last2"] if facts["bases2"] else 0
        if bigrams * facts["relative"] >= 1 << 63:
            raise OverflowError("the keys of the trigrams do not fit 64 bits")
        trigrams = count_runs(encoded, lambda: Model(facts, files).trigram_keys, facts["total"])

        def build_backoffs(number, context, followers, counts):
            backoffs = np.full(ENTRIES, CODES, np.uint16)
            totals = Model(facts, files).of_bigrams("counts", context)
            backoffs[context - number * ENTRIES] = _encode_log(np.log10(1 - (counts - DISCOUNT * followers) / totals))
            return _store(folder, 4, number, {"backoffs": backoffs})

        parts = sum(1 for file in files if file[0] == 2)
        self.files += _files(_build_sums(_group_sums(trigrams, facts["relative"], ENTRIES), build_backoffs, parts))
        files, store = list(self.files), _range_store(folder)

        def build(keys, counts):
            model = Model(facts, files)
            contexts, back = np.unique(keys // facts["relative"], return_inverse=True)
            totals, backoff = model.of_bigrams("counts", contexts), 10.0 ** model.bigram_backoffs(contexts)
            heads = model.heads(model.second_words(contexts))
            lower = model.of_bigrams("codes", heads[back] + keys % facts["relative"])
            chance = (counts - DISCOUNT) / totals[back] + backoff[back] * 10.0**lower
            return store(3, keys, {"codes": _encode_log(np.log10(chance))})

        self.files += _ranges(_build_runs(trigrams, build), 3, self.facts)
        discard(trigrams)


def score_encoded(encoded: DataFrame, facts: dict, files: list[tuple]) -> DataFrame:
    """The encoded documents without their tokens, with ``score``."""

    def work(batches):
        model = Model(facts, files)
        for batch in batches:
            kept = [k for k in batch.schema.names if k != "numbers"]
            for part, words, starts in _token_parts([batch]):
                score = np.add.reduceat(model.score(words, starts), starts)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(score)], [*kept, "score"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return encoded.mapInArrow(work, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on all documents outside the held-out fold and score every row of ``docs``.

    Result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 of
    the whole text). Null and empty texts have their end alone. Repeated rows count and are scored
    as often as they stand there. Without training documents all words are unknown alike. An empty
    table gives an empty result. Other columns are not read.
    """
    model = Builder(docs)
    encoded = settle(encode_split(model.split, model.facts, model.files))
    discard(model.split)
    model.add_bigrams(encoded)
    model.add_trigrams(encoded)
    scored = score_encoded(encoded, dict(model.facts), list(model.files))
    return scored.withColumn("train_tokens", F.lit(model.facts["total"]).cast("long"))
