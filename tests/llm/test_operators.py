"""Each operator against a brute-force version, on odd rows and on the smallest tables."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, classifier, components, jaccard, neighbours, packing, pii, quality_rules, queries, substrings, suffixes, superkmers, token_counts
from plumbline.llm.rows import keyed_texts, saved
from tests.conftest import SF
from tests.llm.conftest import passage

WORDS = re.compile("[^\x20\x09-\x0d]+")
NULL = (1 << 63) - 1


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def key(doc_id):
    return NULL if doc_id is None else doc_id


def counted(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# -- encoding, packing, counts ----------------------------------------------


def test_encoder_equals_the_library(library):
    ours = bpe.WordBpe(open(bpe.default_tokenizer(), "rb").read())
    rng = np.random.default_rng(1)
    texts = ["", "aaaa aaaaa", "don't'LL", "İSTANBUL ΣΑΣ", "<|endoftext|>x<|startoftext|>", "՘ x", "日本語 123½²", "é ẞ ﬀ", "a\x1cb\x85c​d", "x" * 3000, "😀👍🏽!!??"]
    ranges = [(32, 127), (0xA0, 0x24F), (0x300, 0x3000), (0x10000, 0x1FFFF)]
    texts += ["".join(chr(rng.integers(*ranges[rng.integers(4)])) for _ in range(rng.integers(1, 40))) for _ in range(500)]
    for mine, theirs in zip(ours.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(mine, "<u4").tolist()
        assert ids == theirs.ids
        assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_one_pair_a_round_gives_the_same_ids():
    ours = bpe.WordBpe(open(bpe.default_tokenizer(), "rb").read())
    words = [b"abababab", b"thethethe", b"aaaaaaa", b"", b"internationalisation"]
    at_once = [x.tolist() for x in ours.merge(words)]
    ours.all_at_once = False
    assert [x.tolist() for x in ours.merge(words)] == at_once


def test_long_words_equal_the_library(library, monkeypatch):
    """One word of a million letters, random ones, and every short word by the way of long ones."""
    encoder = bpe.WordBpe(open(bpe.default_tokenizer(), "rb").read())
    draw = random.Random(3)
    long = ["x" * 1000, "ab" * 700, "".join(draw.choices("etaoinshrdlu", k=5000)), "".join(draw.choices("abé🙂", k=900)), "a" * 257, "a" * 256]
    for text in long:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    began = time.time()
    ids = np.frombuffer(encoder.encode(["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))])[0], "<u4")
    assert time.time() - began < 30 and len(ids) > 100_000
    words = ["the", "quick", "hello", "unbelievable", "x", "naïve", "aaaaaaa", "mississippi"] + ["".join(draw.choices("abcde", k=draw.randint(1, 20))) for _ in range(200)]
    short = bpe.WordBpe(open(bpe.default_tokenizer(), "rb").read()).encode(words)
    monkeypatch.setattr(bpe, "LONG_WORD", 0)
    assert bpe.WordBpe(open(bpe.default_tokenizer(), "rb").read()).encode(words) == short


def test_words_are_split_as_the_pattern_says():
    """F op1: texts were split by ``regex``, twice as slow as ``re`` over the same classes."""
    split, own = re.compile, bpe.regex.compile(bpe.SPLIT)
    made = bpe.WordBpe(Path(bpe.default_tokenizer()).read_bytes())
    assert isinstance(made.ascii_words_of, type(split(""))) and isinstance(made.words_of, type(split("")))
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("'strevmld l12 \t\x1c\x1f\x85\xa0.-_]^\\é") if rng.random() < 0.8 else chr(rng.choice((rng.randrange(0x370), rng.randrange(0x1E00, 0x2C80)))) for _ in range(60))
        assert made.words_of.findall(text) == own.findall(text)
        text = text.encode("ascii", "ignore").decode()
        assert made.ascii_words_of.findall(text) == own.findall(text)
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    assert made.words_of.findall(every) == own.findall(every)
    # Another pattern stays as it is.
    assert bpe.split_pattern("[a-z]+", 0x7F).findall("ab cd") == ["ab", "cd"]


def test_rounds_look_up_new_pairs_only(library, monkeypatch):
    """F op1: every round looked up all pairs of all words again."""
    made, looked, search = bpe.WordBpe(Path(bpe.default_tokenizer()).read_bytes()), [], np.searchsorted
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshr") for _ in range(40)) for _ in range(200)]
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: looked.append(len(v)) or search(a, v, *rest))
    made.learn(words)
    monkeypatch.undo()
    # A merge makes two new pairs at most.
    assert sum(looked) < 3 * sum(map(len, words))
    for w in words:
        assert np.frombuffer(made.known[w], "<u4").tolist() == library.encode(w, add_special_tokens=False).ids


def test_a_full_word_cache_changes_no_ids():
    """Words that are met again stay known while the cache turns over; the others are encoded anew."""
    spec = open(bpe.default_tokenizer(), "rb").read()
    small, large = bpe.WordBpe(spec, most_words=3), bpe.WordBpe(spec)
    draw = random.Random(5)
    for _ in range(200):
        batch = ["the " + " ".join("".join(draw.choices("abc", k=draw.randint(1, 3))) for _ in range(draw.randint(0, 6))) for _ in range(3)]
        assert small.encode(batch) == large.encode(batch)
        assert len(small.known) <= 3 + 18 + 1 and ("the" in small.known)


def test_masking_in_parts(spark):
    """Nulls, empty texts and more texts than a part keep their rows."""
    texts = [None, "", "plain", "mail a.b@example.org now"] * 300
    masked = pii.masked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1))
    assert dict(masked.collect()) == {i: None if t is None else pii.mask(t) for i, t in enumerate(texts)}


def test_round_trip(odd_docs, plain_rows, library):
    def row(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    assert counted(bpe.round_trip(odd_docs)) == Counter(row(*r) for r in plain_rows)
    assert bpe.encode_texts(odd_docs.where("doc_id = 3")).first().ids == []


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(odd_docs, plain_rows, library, capacity):
    found = packing.pack(odd_docs, capacity).toPandas()
    expected = Counter()
    for doc_id, text in plain_rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[key(doc_id), i, at, len(part), zlib.crc32(part.tobytes())] += 1
    found["doc_id"] = [NULL if d is None or d != d else int(d) for d in odd_ids(found.doc_id)]
    assert Counter(map(tuple, found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == expected
    total = int(found.length.sum())
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= capacity
    assert found.sequence_id.nunique() <= total / capacity * 1.25 + 1


def odd_ids(column):
    return [None if pd.isna(v) else v for v in column]


def one_by_one(lengths, capacity):
    """Sequences that best fit decreasing opens, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return len(rooms)


def test_plan_is_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(50):
        histogram = {int(n): int(rng.integers(1, 200)) for n in rng.choice(np.arange(1, 65), 20, replace=False)}
        fill: Counter = Counter()
        for length, first, last, per, sequence, offset in sorted(packing.plan_slots(histogram, 64), key=lambda s: s[-1]):
            for r in range(last - first):
                at = sequence + r // per
                assert fill[at] == offset + r % per * length
                fill[at] += length
        assert max(fill.values()) <= 64 and sum(fill.values()) == sum(n * c for n, c in histogram.items())
        assert len(fill) == one_by_one([n for n, c in histogram.items() for _ in range(c)], 64)
    assert packing.plan_slots({}) == []


def test_token_counts(odd_docs, plain_rows, library):
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in plain_rows]
    rows = token_counts.token_counts(odd_docs).collect()
    assert {r.length: r.n_docs for r in rows} == Counter(lengths)
    for r in rows:
        assert r.n_docs_over == sum(n > r.length for n in lengths) and r.n_tokens == sum(n for n in lengths if n <= r.length)
        assert r.n_tokens_truncated == sum(min(n, r.length) for n in lengths)
        assert r.quantile == pytest.approx(sum(n <= r.length for n in lengths) / len(lengths))
    assert token_counts.quantile_length(token_counts.token_counts(odd_docs), 0.5).first().length == sorted(lengths)[(len(lengths) - 1) // 2]
    histogram = token_counts.length_histogram(odd_docs)
    assert token_counts.truncated_total(histogram, 7).first()[0] == sum(min(n, 7) for n in lengths)


# -- personal data ----------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    ds = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(ds)) % 10 == 0


def plain_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and plain_luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(3)
    parts = ["a@b.c", "a@b.c_d@e.f", "@x.y", "1.2.3.4", "999.1.1.1.5", "01.002.3.4", "4539 1488 0343 6467", "+1 (984) 555-5227", "+", " ", ".", "-", "é", "🙂", "12", "a", "@", "(", "%"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.integers(1, 12)))
        assert [f"{k}:{a}:{b}" for a, b, k in pii.base_spans(text)] == plain_base(text), text


def test_added_kinds_need_a_checksum_or_context():
    assert pii.joined(pii.scored_spans("GB82 WEST 1234 5698 7654 32")).startswith("iban:0:27")
    assert pii.scored_spans("GB83 WEST 1234 5698 7654 32") == []
    assert [s[2] for s in pii.scored_spans("SSN: 123-45-6789")] == ["national_id"]
    assert pii.scored_spans("part 123-45-6789") == []
    assert pii.mask("mail a@b.cd now") == "mail [EMAIL] now"


def test_account_numbers_end_before_a_following_word():
    for account in ("ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "BE68539007547034", "SE45 5000 0000 0583 9825 7466"):
        for after in ("", " BIC", " EUR", " 12", " CODE", " CODE EUR", ", EUR", " Euro"):
            assert pii.joined(pii.scored_spans(account + after)) == f"iban:0:{len(account)}", account + after
            assert pii.mask(f"to {account}{after}") == f"to [IBAN]{after}"
    assert pii.mask("ES91 2100 0418 4502 0005 1332 BE68 5390 0754 7034") == "[IBAN] [IBAN]"
    assert pii.mask("AB12 3456 7891 BE68 5390 0754 7034") == "AB12 3456 7891 [IBAN]"
    assert pii.scored_spans("BE68 5390 0754 7035 EUR") == [] and pii.scored_spans("BE68539007547034EUR") == []


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "1." * 100_000 + "@" * 1000) is not None


def test_added_spans_by_brute_force():
    """Each added span against every span before it, on texts where all kinds crowd and overlap."""
    draw = random.Random(11)
    pieces = ["call 020 7946 0958", "ssn 123-45-6789", "iban GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "+44 20 7946 0958", "a.b@c.example", "10.0.0.1", "4539 1488 0343 6467", "555-123-4567", "(020) 794-6095", "phone", "bank", "x", "12", "DE89 3704 0044 0532 0130 00 EUR"]
    for _ in range(300):
        text = draw.choice([" ", ", ", ""]).join(draw.choices(pieces, k=draw.randint(0, 25)))
        taken = [(a, b, k) for a, b, k in pii.base_spans(text)]
        for kind, places in (("iban", list(pii.accounts(text))), ("national_id", [m.span() for m in pii.NATIONAL_ID.finditer(text)]), ("local_phone", [m.span() for m in pii.LOCAL_PHONE.finditer(text)])):
            for a, b in places:
                near = (text[max(0, a - pii.CONTEXT_CHARS) : a] + " " + text[b : b + pii.CONTEXT_CHARS]).lower()
                score = pii.START[kind] + pii.CHECKED * (kind == "iban") + pii.NEARBY * any(re.search(rf"\b{re.escape(w)}", near) for w in pii.CONTEXT[kind])
                if score >= pii.LEAST_SCORE and all(b <= x or a >= y for x, y, _ in taken):
                    taken.append((a, b, kind))
        assert [s[:3] for s in pii.scored_spans(text)] == sorted(taken, key=lambda s: (s[0], pii.RANK[s[2]], s[1]))


def test_dense_contacts_take_linear_time():
    text = "phone 020 7946 0958, ssn 123-45-6789; call 555-123-4567\n" * 20_000
    began = time.time()
    assert len(pii.scored_spans(text)) >= 40_000 and time.time() - began < 30


def test_personal_data_query(odd_docs, plain_rows):
    rows = pii.span_digest(pii.find_personal_data(odd_docs)).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in rows) == Counter((i, sha(",".join(plain_base(t or "")))) for i, t in plain_rows)
    for r in rows:
        assert r.n_email + r.n_ip + r.n_card + r.n_phone <= len(r.spans.split(","))
    out = pii.masked(odd_docs)
    assert out.columns == odd_docs.columns and out.where("text is null").count() == 1
    assert "[EMAIL]" in out.where("doc_id = 13").first().text


# -- substrings -------------------------------------------------------------


def plain_words(rows, window):
    order = sorted(rows, key=lambda r: key(r[0]))
    first, out = {}, {}
    for doc_id, text in order:
        words = WORDS.findall(text or "")
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), (key(doc_id), text, i))
    for doc_id, text in order:
        words = WORDS.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] != (key(doc_id), text, i):
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc_id, text] = (doc_id, len(words), sum(gone), sha(" ".join(kept)))
    return out


def unlike(rows):
    """Without rows that repeat an id with another text, whose order is the hash's."""
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    return [r for r in rows if len(texts[r[0]]) == 1]


def test_words_that_occur_earlier(odd_docs, plain_rows):
    ids = [i for i, _ in unlike(plain_rows)]
    docs = odd_docs.where(F.col("doc_id").isin([i for i in ids if i is not None]))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = plain_words(rows, 20)
    assert counted(substrings.kept_digest(substrings.kept_words(docs))) == Counter(expected[r] for r in rows)
    assert substrings.kept_words(odd_docs).count() == len(plain_rows)


def test_words_on_the_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected = Counter(plain_words(rows, 20).values())
    for strings in (None, substrings.WordStrings(20, 8, frequent=2), FewHashesOfWords(20, 8)):
        assert counted(substrings.kept_digest(substrings.kept_words(documents, strings=strings))) == expected


class FewHashesOfWords(substrings.WordStrings):
    """Hashes that bring unlike windows together."""

    def grams(self, flat):
        return super().grams(flat) % np.uint64(5)

    def window_hashes(self, numbers):
        return super().window_hashes(numbers) % np.uint64(3)


class FewHashesOfBytes(suffixes.ByteStrings):
    def grams(self, flat):
        return super().grams(flat) % np.uint64(5)

    def window_hashes(self, numbers):
        return super().window_hashes(numbers) % np.uint64(3)


def plain_bytes(rows, length):
    first, out = {}, []
    for doc_id, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            first[raw[i : i + length]] = min(first.get(raw[i : i + length], NULL), key(doc_id))
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < key(doc_id):
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(raw), int(gone.sum()), spans, sha(np.frombuffer(raw, np.uint8)[~gone].tobytes())))
    return Counter(out)


def test_bytes_that_earlier_documents_have(odd_docs, plain_rows, documents):
    assert counted(suffixes.kept_digest(suffixes.kept_bytes(odd_docs))) == plain_bytes(plain_rows, 50)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert counted(suffixes.kept_digest(suffixes.kept_bytes(documents))) == plain_bytes(rows, 50)


def test_cleaned_keeps_columns_and_characters(spark):
    shared = "é" * 40
    docs = spark.createDataFrame([(1, "a" + shared, 41), (2, shared + "tail", 44), (3, shared, 40), (4, None, 0), (5, "", 0)], "doc_id long, text string, n_chars int")
    rows = {r.doc_id: (r.text, r.n_chars) for r in suffixes.cleaned(docs).collect()}
    assert rows == {1: ("a" + shared, 41), 2: ("tail", 4), 4: (None, 0), 5: ("", 0)}


def test_bytes_with_few_hashes_and_frequent_minimisers(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected = plain_bytes(rows, 50)
    for strings, batches in ((FewHashesOfBytes(), 1), (FewHashesOfBytes(frequent=2), 2), (suffixes.ByteStrings(frequent=2), 5)):
        assert counted(suffixes.kept_digest(suffixes.kept_bytes(documents, strings=strings, batches=batches))) == expected


def test_unlike_bytes_with_equal_hashes_stay(spark):
    """Two strings made to share a hash of their eights."""
    rows = [(1, "qwyL19S83w v the endQLLiCMuioNzmkanF2DF8GqbmAAuqO9"), (2, "zFfrUx1NnOqU the endQLLiCMuioNzmkanF2DF8GqbmAAuqO9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(suffixes.kept_digest(suffixes.kept_bytes(docs))) == plain_bytes(rows, 50)


def test_an_index_takes_batches_in_any_number(spark, documents, tmp_path):
    """Levels stay twice as large as the next, and what scans of several batches note settles as in one run."""
    plain = keyed_texts(documents)
    kind, layout = suffixes.ByteStrings(), superkmers.Layout(5, 7)
    index = suffixes.SuffixIndex(spark, str(tmp_path), kind, layout)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    # Later ids first: an index takes batches of any ids.
    for i in (3, 1, 0, 2, 4):
        index.add(plain.where(F.pmod("okey", F.lit(5)) == i), 100)
        sizes = [n for n, _ in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == 100 * len(index.scans)
    level = index.rows(index.levels[-1][1], "level").collect()
    for row in level:
        (steps, okeys, _), _ = superkmers.unpack(row.blob, suffixes.LEVEL_KINDS)
        assert len(steps) == len(okeys) > 0
    texts = superkmers.pressed(plain, layout, [])
    ranges = superkmers.covered_ranges(texts, index.noted(), kind, layout)

    def apply(table, raws, pairs):
        return {"doc_id": table.column("okey"), "n": [int(superkmers.covered(len(t), p).sum()) for t, p in zip(raws, pairs)]}

    found = Counter({(r.doc_id, r.n) for r in superkmers.with_ranges(texts, ranges, apply, "doc_id long, n long").collect()})
    assert found == Counter({(r[0], r[2]) for r in plain_bytes(rows, 50)})


def test_documents_longer_than_a_part(spark):
    """Words and bytes of a document that is cut, with repeats across the cut and in another document."""
    n = superkmers.PART_TOKENS
    words = [f"{i:x}" for i in range(n + 5000)]
    words[n - 10 : n + 30] = words[100:140]
    words[n + 3000 : n + 3060] = words[n - 5 : n + 55]
    text = " ".join(words)
    rows = [(1, text), (2, "some words before " + text[n - 200 : n + 300] + " and after " + " ".join(words[n + 4000 : n + 4100]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert counted(substrings.kept_digest(substrings.kept_words(docs))) == Counter(plain_words(rows, 20).values())
    assert counted(suffixes.kept_digest(suffixes.kept_bytes(docs))) == plain_bytes(rows, 50)


def test_the_greatest_id_and_none_are_two(spark):
    """A row without an id is later than the greatest legal one."""
    shared = passage(1, 60)
    rows = [(NULL, shared), (None, shared), (None, "more " + shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for found in (substrings.kept_words(docs), suffixes.kept_bytes(docs)):
        assert {(r[0], r[2] > 0) for r in found.collect()} == {(NULL, False), (None, True)}


def test_long_documents_are_cut(monkeypatch):
    tokens = list(range(2500))
    monkeypatch.setattr(superkmers, "PART_TOKENS", 1000)
    parts = [p for p in superkmers.parts_of([tokens, [1, 2]], 20)]
    windows = sorted(o + i for p in parts for o, t in zip(p.offset, p.tokens) for i in range(len(t) - 19))
    assert windows == list(range(2481))


def test_different_windows_with_one_hash_are_told_apart():
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    kind = substrings.WordStrings(3, 2)
    group = superkmers.exact_groups(np.zeros(3, np.uint64), np.array([0, 3, 6]), 3, ids, kind.equal)
    assert group[0] == group[2] != group[1]


def sent_of(rows, kind, layout):
    """What a part of the corpus with all ``rows`` sends if every place is asked for: its strings' places by bucket."""
    okey, raws = np.array([i for i, _ in rows]), [t for _, t in rows]
    table = pa.table({"part": pa.array([0] * len(rows), pa.int32()), "okey": okey, "nul": [False] * len(rows), "body": [zstandard.compress(t) for t in raws]})
    places = [(okey[f.row], f.place) for f in superkmers.found_in(kind, raws)]
    okeys, place = (np.concatenate(c) for c in zip(*places))
    blob = superkmers.pack(zip((superkmers.steps(okeys), place, np.zeros(len(place))), superkmers.ASKED_KINDS))
    out = superkmers.sent_strings(kind, layout, table, pa.table({"copies": [False], "blob": [blob]}))
    return [(b, superkmers.unpack(x, superkmers.STRING_KINDS)) for b, x in zip(out.column("bucket").to_pylist(), out.column("blob").to_pylist()) if b >= 0]


def test_asked_places_are_not_hashed_again_for_every_part(monkeypatch):
    """F op9: with every piece of the texts all places that are asked for went into a hash table."""
    kind, layout = suffixes.ByteStrings(), superkmers.Layout(2, 1)
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(97, 123, 700, np.uint8).tobytes()) for i in (9, 4, 6, 1)]
    monkeypatch.setattr(superkmers, "PART_TOKENS", 600)
    n = sum(int(f.windows.sum()) for f in superkmers.found_in(kind, [t for _, t in rows]))
    looked, isin = [], np.isin
    monkeypatch.setattr(np, "isin", lambda a, b, **how: looked.append(len(b)) or isin(a, b, **how))
    sent = sent_of(rows, kind, layout)
    assert not looked
    # Unlike texts: each super-k-mer travels, with all its windows.
    texts = dict(rows)
    assert sum(int(columns[1].sum()) for _, (columns, _) in sent) == n == 4 * 651
    for _, (columns, tail) in sent:
        ends = np.cumsum(columns[0].astype(np.int64))
        strings = [tail[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        for number, okey, start in zip(np.cumsum(columns[2]), columns[3], columns[5]):
            assert texts[okey][start : start + len(strings[number])] == strings[number]


def test_orders_by_packed_places():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 50, 1000)
    assert superkmers.order_by(keys).tolist() == np.argsort(keys, kind="stable").tolist()
    # Hashes that differ in their low bits only are no two runs, minimisers are.
    hashes = (rng.integers(0, 9, 1000).astype(np.uint64) << np.uint64(55)) + rng.integers(0, 2, 1000).astype(np.uint64)
    order, fresh = superkmers.order_by_hash(hashes)
    assert order.tolist() == np.argsort(hashes >> np.uint64(10), kind="stable").tolist() and fresh.sum() == 9
    row = np.sort(rng.integers(0, 30, 1000))
    order, head = superkmers.Found(b"", row, row, row, row, row, hashes).groups()
    assert order.tolist() == np.argsort(hashes, kind="stable").tolist()
    assert len(head) == len(set(zip(hashes.tolist(), row.tolist())))
    # Windows of three tokens; the hash tells the first one alone, and the second by its lowest bit.
    tokens = rng.integers(0, 3, 1003)
    hashes = (tokens[:1000].astype(np.uint64) << np.uint64(55)) + (tokens[1:1001] % 2).astype(np.uint64)
    group = superkmers.exact_groups(hashes, np.arange(1000), 3, tokens, lambda t, a, b: np.logical_and.reduce([t[a + i] == t[b + i] for i in range(3)]))
    plain = [tuple(tokens[i : i + 3].tolist()) for i in range(1000)]
    assert len(set(zip(group.tolist(), plain))) == len(set(group.tolist())) == len(set(plain))
    kind, number, rank = suffixes.ByteStrings(), rng.integers(0, 40, 200), rng.integers(0, 60, 200)
    zero = np.zeros(200, np.int64)
    assert superkmers.is_later(kind, number, rank, zero, zero).tolist() == [bool(r > rank[number == n].min()) for n, r in zip(number, rank)]


def test_ranges_merge_by_document():
    okey, flag = np.array([5, 1, 1, 1, 5]), np.array([0, 0, 0, 1, 0])
    found = superkmers.merged(okey, flag, np.array([7, 4, 0, 0, 1]), np.array([9, 6, 4, 2, 8]))
    assert [list(c) for c in found] == [[1, 1, 5], [0, 1, 0], [0, 0, 1], [6, 2, 9]]


def test_vectors_of_any_size(spark):
    """Very large and very small components end, and the nearest are those of brute force."""
    rng = np.random.default_rng(2)
    for scale in (1e200, 1e-200, 1e300, 1.0):
        vectors = rng.standard_normal((40, 8)) * scale * np.where(np.arange(40) % 3, 1.0, 1e-3)[:, None]
        rows = [(i, v.tolist(), 1.0, "x") for i, v in enumerate(vectors)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, query_id string")
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), top=5).collect()}
        for q in (0, 20):
            with np.errstate(over="ignore", invalid="ignore"):
                score = (vectors * vectors[q]).sum(1)
            score = np.where(np.isnan(score), -np.inf, score)
            near = [i for i in np.lexsort((np.arange(40), -score)).tolist() if i != q][:5]
            assert [got[q, k + 1][0] for k in range(5)] == near


# -- near duplicates --------------------------------------------------------


def plain_components(rows, n, num, den):
    sets, parent = {}, {}
    for doc_id, text in rows:
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
        sets[doc_id] = frozenset(grams)
        parent[doc_id] = doc_id

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for x in ids:
        for y in ids:
            if x < y and (both := len(sets[x] & sets[y])) and both * den >= num * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 4, 5)])
def test_near_duplicates_on_the_table(documents, n, num, den):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {tuple(r) for r in jaccard.near_duplicates(documents, n, num, den).collect()} == plain_components(rows, n, num, den)


def test_chains_and_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        words[int(rng.integers(0, 120))] = f"e{i}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(60)]
    for i in range(30):
        chain[2 * i % 60] = f"d{i}"
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000, "One two"), (2001, "one TWO"), (2002, ""), (2003, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n, num, den in ((3, 90, 100), (2, 4, 5)):
        assert {tuple(r) for r in jaccard.near_duplicates(docs, n, num, den).collect()} == plain_components(rows, n, num, den)


def test_frequent_passages_with_rare_additions(spark):
    """A copy with rare additions asks for fewer shared shingles than its frequent passage alone, and shares no more."""
    rows = []
    for i, added in enumerate((1, 6, 10, 12, 13)):
        frequent = passage(100 + i, 52)
        rows += [(100 * i, frequent), (100 * i + 1, frequent + " " + passage(200 + i, added))]
        rows += [(100 * i + 2 + j, frequent + " " + passage(1000 + 20 * i + j, 350)) for j in range(20)]
    rows += [(10_000 + i, passage(10_000 + i, 8)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = plain_components(rows, 5, 4, 5)
    assert {d for d, _, c in expected if d != c} == {1, 101, 201, 301}
    assert {tuple(r) for r in jaccard.near_duplicates(docs).collect()} == expected


@pytest.mark.parametrize("few", [2, 16])
def test_documents_of_common_sentences(spark, monkeypatch, few):
    """Documents put together from a few sentences: unlike ones share every token with many, and among them lie near copies of some."""
    monkeypatch.setattr(jaccard, "FEW_DOCS", few)
    monkeypatch.setattr(jaccard, "DOCS_A_SHINGLE", 0.0)
    draw = random.Random(5)
    pool = [" ".join(f"w{i}x{j}" for j in range(10)) for i in range(30)]
    texts = [" ".join(draw.sample(pool, 12)) for _ in range(150)]
    for i in range(0, 60, 3):
        words = texts[i].split()
        words[draw.randrange(len(words))] = f"new{i}"
        texts.append(" ".join(words))
    texts += ["a b c d", "a b c d e", "b c d e"] + [pool[0], pool[0] + " end"]
    sets = [set(zip(*(t.split()[k:] for k in range(3)))) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    found = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 3, 90, 100)
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(label)) and len(set(label)) < len(texts) - 15


def test_similar_sets_share_parts():
    draw = np.random.default_rng(2)
    for numerator, denominator in ((90, 100), (4, 5)):
        parts, none = jaccard.Parts(numerator, denominator), 0
        for _ in range(1500):
            common = draw.integers(0, 2**64, int(draw.integers(5, 300)), np.uint64)
            spare = int(len(common) * (denominator - numerator) / numerator)
            extra = draw.integers(0, 2**64, spare, np.uint64)
            cut = int(draw.integers(0, spare + 1))
            x, y = np.unique(np.concatenate([common, extra[:cut]])), np.unique(np.concatenate([common, extra[cut:]]))
            assert len(np.intersect1d(x, y)) * denominator >= numerator * len(np.union1d(x, y))
            a, b = parts.keys(x), parts.keys(y)
            none += a is None or b is None
            if a is not None and b is not None:
                assert max(len(np.intersect1d(p, q)) for p in a for q in b) >= jaccard.MOST_PARTS
        assert none < 500


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 4, 5)])
def test_copies_near_the_threshold(spark, n, num, den):
    """Groups whose members are nearly similar: edits from few words, cuts and additions, so that rounds by hubs and neighbours leave links."""
    rng = np.random.default_rng(8)
    rows = []
    for group in range(4):
        base = passage(50 + group, 110).split()
        for i in range(70):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(1, 6))):
                words[at] = f"e{rng.integers(0, 3)}"
            if i % 5 == 0:
                words = words[int(rng.integers(0, 12)) :]
            if i % 7 == 0:
                words += [f"t{rng.integers(0, 4)}" for _ in range(int(rng.integers(1, 10)))]
            rows.append((int(rng.integers(0, 10**6)) * 1000 + len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = plain_components(rows, n, num, den)
    assert 8 < len({c for _, _, c in expected})
    assert {tuple(r) for r in jaccard.near_duplicates(docs, n, num, den).collect()} == expected


def test_words_met_by_chance_make_no_partners(spark):
    """Each document shares a tenth of its words with others, which two of a short prefix are often and all that a long one asks for never."""
    draw = random.Random(4)
    rows = [(i, " ".join([f"own{i}x{j}" for j in range(180)] + draw.sample([f"pool{j}" for j in range(2000)], 20))) for i in range(400)]
    rows += [(1000 + i, rows[i][1].replace(f"own{i}x7 ", f"new{i} ")) for i in range(0, 400, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets, counts = jaccard.counted_sets(docs, 1)
    # As in a large corpus, classes of hashes do not tell rare words from others.
    prefixes = jaccard.Prefixes(np.ones_like(counts), sets.count(), 90, 100)
    found = {r.doc_id for r in jaccard.partners(docs, prefixes, 1).collect()}
    assert found == {k + i for i in range(0, 400, 40) for k in (0, 1000)}
    assert {tuple(r) for r in jaccard.near_duplicates(docs, 1, 90, 100).collect()} == plain_components(rows, 1, 90, 100)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_shingles_of_odd_texts(n):
    """Words are cut and told apart as by bytes.split(), whatever texts lie beside them and however long they are."""
    draw = random.Random(n)
    pieces = [b"a", b"B", b"b", b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\0", "\u00a0".encode(), "\u00c9".encode(), b"abcdefgh"]
    long = [b"x" * k for k in (7, 8, 9, 16, 255, 256, 257, 600)]
    texts = [b"".join(draw.choice(pieces + long) for _ in range(draw.randrange(0, 25))) for _ in range(600)] + [b"y z " * 200_000, b""]
    ids = {}
    for text, found in zip(texts, jaccard.shingle_sets(texts, n), strict=True):
        words = text.lower().split()
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
        assert found.dtype == np.uint64 and (np.diff(found.astype(object)) > 0).all() and len(found) == len(grams)
        assert (found == jaccard.shingle_sets([text], n)[0]).all()
        assert ids.setdefault(frozenset(grams), found.tobytes()) == found.tobytes()
    assert len(set(ids.values())) == len(ids)


@pytest.mark.parametrize("few, bitmaps", [(100_000, 2000), (0, 2000), (0, 0)])
def test_ids_as_bits(spark, monkeypatch, few, bitmaps):
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", few)
    monkeypatch.setattr(jaccard, "MOST_BITMAPS", bitmaps)
    ids = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 65537, -1, -32768, -32769, 2**62, 2**63 - 1, -(2**63)]
    near = sorted({i + d for i in ids for d in (-8, -1, 0, 1, 8) if -(2**63) <= i + d < 2**63})
    rows = spark.createDataFrame([(i,) for i in [*near, near[3], None]], "doc_id long")
    picked = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    inside = [r.doc_id for r in jaccard.among(rows, picked).collect()]
    outside = [r.doc_id for r in jaccard.among(rows, picked, but=True).collect()]
    assert Counter(inside) == Counter(r.doc_id for r in rows.collect() if r.doc_id in ids)
    assert Counter(outside) == Counter(r.doc_id for r in rows.collect() if r.doc_id not in ids)


def test_what_is_broadcast_of_many_ids_is_bits(spark):
    ids = jaccard.saved(spark.range(jaccard.MOST_BROADCAST + 1).select((F.col("id") * 3).alias("doc_id")))
    found = jaccard.among(spark.range(400_000).select(F.col("id").alias("doc_id")), ids)
    assert "_bits" in found._jdf.queryExecution().toString()
    assert found.count() == jaccard.MOST_BROADCAST + 1 and found.where("doc_id % 3 <> 0").isEmpty()


def shuffle_files(spark):
    conf = spark.sparkContext.getConf()
    tops = {conf.get("spark.local.dir", "/tmp"), *os.environ.get("SPARK_LOCAL_DIRS", "").split(",")} - {""}
    mine = [d for top in tops for d in Path(top).glob("blockmgr-*")]
    return {f for d in mine for f in d.rglob("shuffle_*")}


def test_saved_leaves_no_shuffle_files(spark):
    df = spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count()
    before = shuffle_files(spark)
    found = saved(df)
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    # What has no files any more is made again where it is asked for.
    assert found.count() == df.count() == saved(df).count() == 1000


def test_near_duplicates_of_odd_rows(odd_docs, plain_rows):
    found = jaccard.near_duplicates(odd_docs).collect()
    assert len(found) == len(plain_rows)
    by_id = {r.doc_id: r.component_id for r in found if r.doc_id not in (None, 8)}
    assert by_id[7] == 6 and by_id[10] == by_id[11] == 10 and by_id[3] == 3 and by_id[4] == 4
    kept = jaccard.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} >= {None, 1, 3, 4, 5, 6, 9, 10}
    assert {7, 11}.isdisjoint({r.doc_id for r in kept.collect()})


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 98), (7, 7)], "a long, b long")
    labels = {r.id: r.label for r in components.components(links).collect()}
    assert labels == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}


# -- quality ----------------------------------------------------------------


def plain_counts(text):
    words = WORDS.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts(odd_docs, plain_rows, documents):
    for docs, rows in ((odd_docs, plain_rows), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        assert counted(quality_rules.text_counts(docs).select("doc_id", *COUNTS)) == Counter((i, *plain_counts(t)) for i, t in rows)


def test_counts_when_hash_bits_collide(documents, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 60)
    rows = documents.limit(40)
    expected = Counter((r.doc_id, *plain_counts(r.text)) for r in rows.collect())
    assert counted(quality_rules.text_counts(rows).select("doc_id", *COUNTS)) == expected


def test_binomial_tail(spark):
    from math import comb, log

    cases = [(100, 0), (500, 3), (2000, 10), (50, 0)]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("v", quality_rules.binomial_log_cdf(F.col("n"), F.col("k"), 0.02))
    for r in df.collect():
        assert r.v == pytest.approx(log(sum(comb(r.n, j) * 0.02**j * 0.98 ** (r.n - j) for j in range(r.k + 1))), rel=1e-9)


def test_cutoffs_bound_false_rejection(spark):
    rows = [(i, "en", False, 0.4 if i % 10 == 0 else 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(5000)]
    rows += [(i, "de", False, 0.4, 0.0, 0.0, 0.0, 0.0) for i in range(5000, 5020)]
    values = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, symbol_share double, capital_share double, bang_share double, repeat_share double, dup_line_share double")
    marks = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(5020)] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = {r.stratum: r for r in quality_rules.certified_cutoffs(values, marks).collect()}
    # Rows that repeat a document are one draw.
    again = quality_rules.certified_cutoffs(values.union(values.where("doc_id % 10 = 1")), marks)
    assert {r.stratum: r.asDict() for r in again.collect()} == {k: r.asDict() for k, r in found.items()}
    # Every cutoff below 0.4 catches the bad ones; too few German rows to certify anything.
    assert set(found) == {"en"} and found["en"].cut_symbol_share == 0.3 and found["en"].cut_bang_share is None


def test_verdicts(odd_docs, labels):
    out = quality_rules.judged(odd_docs, labels)
    assert out.where("kept and base_failed").count() == 0 and out.count() == odd_docs.count()
    kept = quality_rules.filtered(odd_docs, labels)
    assert kept.columns == odd_docs.columns and 0 < kept.count() < odd_docs.count()


def plain_shares(text):
    n_words, chars, n_symbols, n_dup, n_repeat = plain_counts(text)
    lines = sum(bool(WORDS.search(x)) for x in (text or "").split("\n"))
    values = {"symbol_share": n_symbols / max(1, chars), "capital_share": len(re.findall("[A-Z]", text or "")) / max(1, chars), "bang_share": (text or "").count("!") / max(1, n_words)}
    values |= {"repeat_share": n_repeat / max(1, n_words), "dup_line_share": n_dup / max(1, lines)}
    return n_words < 50 or 100 * n_repeat > 50 * n_words, values


def test_kept_by_plain_rules(spark):
    """``kept`` of a whole table: shares, exact binomial tails, cutoffs in their order and verdicts, one by one."""
    q = quality_rules
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = {r.doc_id: (r.lang if r.lang in q.STRATA[:-1] else q.STRATA[-1], *plain_shares(r.text)) for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in marks.collect() if r.quality is not None}
    cutoffs, share = {}, q.LEVEL / (len(q.STRATA) * len(q.GRID))
    for stratum in q.STRATA:
        held = [(rows[i][2], y) for i, y in quality.items() if i in rows and rows[i][0] == stratum and not rows[i][1]]
        n = sum(y == 1 for _, y in held)
        for rule, cuts in q.GRID.items():
            best, sound = None, True
            for step, cut in enumerate(cuts):
                k, bad = (sum(v[rule] > cut for v, y in held if y == mark) for mark in (1, 0))
                sound = sound and k < n * q.MOST_REJECTED and sum(math.comb(n, j) * q.MOST_REJECTED**j * (1 - q.MOST_REJECTED) ** (n - j) for j in range(k + 1)) <= share
                if sound and bad > k and (best is None or bad - k > best[0]):
                    best = (bad - k, cut)
            if best:
                cutoffs[stratum, rule] = best[1]
    assert cutoffs
    expected = {i: not failed and not any(values[rule] > cutoffs.get((stratum, rule), math.inf) for rule in q.GRID) for i, (stratum, failed, values) in rows.items()}
    out = queries.op8_quality_rules(spark, "/root/testdata/sf0.1").collect()
    assert {r.doc_id: (r.base_failed, r.kept) for r in out} == {i: (rows[i][1], kept) for i, kept in expected.items()}


def test_quality_rules_run_no_python(documents, labels):
    plan = quality_rules.judged(documents, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_classifier_on_held_out_rows(spark, odd_docs):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    scored = classifier.score_quality(docs, marks)
    held = scored.join(marks, "doc_id").where(classifier.is_held_out("doc_id")).toPandas()
    right = ((held.score >= classifier.CUTOFF) == (held.quality == 1)).mean()
    assert len(held) > 50 and right > 0.93 and held.score.between(0, 1).all()
    odd = classifier.score_quality(odd_docs, marks.where("quality is null"))
    assert {r.score for r in odd.collect()} == {0.5} and odd.count() == odd_docs.count()
    assert classifier.score_quality(odd_docs, spark.createDataFrame([(1, 1), (1, 0), (6, 1), (None, 1)], "doc_id long, quality int")).where("score between 0 and 1").count() == odd_docs.count()


def test_votes_equal_plain_ones(spark):
    """Every score against cosines one by one: all labelled texts, in the directions of their own features."""
    docs, marks = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    learnt = {r.doc_id: r.quality for r in marks.collect() if r.quality is not None and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    x = np.array([classifier.features([texts[i]])[0].astype(np.float16) for i in learnt], float)
    _, _, right = np.linalg.svd(x, full_matrices=False)

    def unit(row):
        y = right[: classifier.DIMENSIONS] @ row
        return y / max(np.linalg.norm(y), 1e-12)

    voters = [(unit(row), mark) for row, mark in zip(x, learnt.values())]

    def score(text):
        near = sorted(((float(unit(classifier.features([text])[0]) @ v), mark) for v, mark in voters), reverse=True)[: classifier.NEIGHBOURS]
        weights = [max(c, 0.0) ** classifier.SHARPNESS for c, _ in near]
        return sum(w * mark for w, (_, mark) in zip(weights, near)) / sum(weights)

    found = queries.op2_quality_classifier(spark, SF).toPandas()
    assert len(found) == len(texts) and len(voters) > 2 * classifier.NEIGHBOURS
    plain = np.array([score(texts[i]) for i in found.doc_id])
    assert np.quantile(abs(found.score - plain), 0.95) < 1e-3 and abs(found.score - plain).max() < 0.1
    assert (found.predicted == (found.score >= 0.7)).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()


def test_the_sample_is_of_documents(spark):
    """Labels without a document take no place; repeated documents count once; the same rows are chosen whatever the partitions."""
    rows = [(i, passage(i, 5)) for i in range(40)] * 2 + [(3, "a later text"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(4, 0), (5, None)], "doc_id long, quality int")
    sample = [sorted(map(tuple, classifier.labelled_sample(docs.repartition(n), marks, most=20).collect())) for n in (1, 7)]
    learnt = {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert sample[0] == sample[1] and len(sample[0]) == 20
    everything = Counter(map(tuple, classifier.labelled_sample(docs, marks).collect()))
    assert everything == Counter(("a later text" if i == 3 else passage(i, 5), float(i % 2 and i != 4)) for i in learnt)


# -- neighbours -------------------------------------------------------------


def exact(vectors, queries, top):
    out = {}
    for q, x in queries.items():
        rows = sorted((-float((np.array(v) * x).sum()), i) for i, v in vectors.items() if i != q)
        out[q] = [i for _, i in rows[:top]]
    return out


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    found = queries.op4_collision_counting(spark, "/root/testdata/sf0.01").toPandas()
    best = exact(data, {i: v for i, v in data.items() if i % 20 == 0}, 20)
    assert set(found.query_id) == set(best)
    hits = [len(set(own.vec_id) & set(best[q])) / 20 for q, own in found.groupby("query_id")]
    assert np.mean(hits) >= 0.9
    for _, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and (own.score.diff().dropna() <= 0).all()
    for r in found.head(50).itertuples():
        assert r.score == pytest.approx(float((data[r.query_id] * data[r.vec_id]).sum()), abs=1e-12)


def recall_of(found, ids, x, every):
    hits = []
    assert set(found.query_id) == set(ids[ids % every == 0])
    for q, own in found.groupby("query_id"):
        score = np.where(ids == q, -np.inf, x @ x[np.searchsorted(ids, q)])
        hits.append(len(set(own.vec_id) & set(ids[np.argsort(-score, kind="stable")[:20]])) / 20)
    return np.mean(hits)


def test_recall_where_the_floor_of_candidates_ends(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = vectors.toPandas().sort_values("vec_id")
    found = neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0)).toPandas()
    assert recall_of(found, data.vec_id.to_numpy(), np.stack(data.embedding.to_numpy()).astype(float), 20) >= 0.9


def test_few_vectors_are_verified():
    """The share of a block that is verified, and the recall there, on unlike vectors and on ones with neighbours; printed with -s."""
    rng = np.random.default_rng(3)
    for n, planted in ((2000, 0), (8192, 0), (8192, 40)):
        x = rng.normal(size=(n, 64))
        for q in range(0, n if planted else 0, 500):
            x[q + 1 : q + 1 + planted] = x[q] + 0.5 * rng.normal(size=(min(planted, n - q - 1), 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        directions = np.random.default_rng(neighbours.SEED).standard_normal((65, neighbours.PROJECTIONS))
        block = neighbours.Block(np.column_stack([x, np.zeros(n)]), x, [np.array([i]) for i in range(n)], directions)
        asked = range(0, n, 500)
        enough = max(neighbours.ENOUGH * 21, int(neighbours.ENOUGH_SHARE * n))
        found = block.candidates(x[list(asked)] @ directions[:-1], int(np.ceil(neighbours.COLLISIONS * neighbours.PROJECTIONS)), enough)
        share = np.mean([len(f) for f in found]) / n
        recall = np.mean([len(set(f) & set(np.argsort(-(x @ x[q]))[1:21])) / 20 for q, f in zip(asked, found)])
        print(f"{n} vectors, {planted} neighbours: {share:.3f} verified, recall {recall:.3f}")
        assert share < 1.35 * enough / n and recall > (0.99 if planted else 0.85)


def test_recall_on_full_blocks(spark):
    """Vectors made here, more than fill several blocks: every query has 25 planted neighbours."""
    rng, n, every = np.random.default_rng(7), 60_000, 1000
    x = rng.normal(size=(n, 64))
    for q in range(0, n, every):
        x[q + 1 : q + 26] = x[q] + 0.5 * rng.normal(size=(25, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<double>").repartition(4)
    assert n >= 4 * neighbours.BLOCK
    found = neighbours.nearest(vectors, vectors.where(F.col("vec_id") % every == 0)).toPandas()
    assert recall_of(found, np.arange(n), x, every) >= 0.9


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (9, [2.0, 0.0]), (8, [2.0, 0.0]), (10, [0.5, 9.0]), (11, [1.0, 2.0, 3.0]), (None, [5.0, 5.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(vectors, vectors.where("vec_id in (0, 3, 11)"), top=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [(0, 1, 7, 2.0), (0, 2, 8, 2.0), (0, 3, 9, 2.0)]
    assert neighbours.nearest(vectors.limit(0), vectors).count() == 0


# -- empty tables, and the whole set ----------------------------------------


def test_empty_tables(spark, documents, labels):
    none = documents.limit(0)
    for out in (
        packing.pack(none), pii.span_digest(pii.find_personal_data(none)), bpe.round_trip(none), token_counts.token_counts(none),
        quality_rules.judged(none, labels), classifier.score_quality(none, labels), substrings.kept_words(none), suffixes.kept_bytes(none), jaccard.near_duplicates(none),
    ):
        assert out.count() == 0
    assert quality_rules.judged(documents.limit(5), labels.limit(0)).count() == 5


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
