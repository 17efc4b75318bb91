"""Harmonic packing, token links and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from synthspark.llm import byte_bpe, harmonic, spellings, token_links
from synthspark.llm.queries import QUERIES
from synthspark.session import stored
from tests.conftest import SMALL

CLASHES = "id key word near n size lo hi core run radix payload docs into known length start offset sequence_id _task _rank _before text_col form root".split()
ODD = [None, "", " ", "  \n\t ", "x", "<|endoftext|> and <s> </s> <0x41>", "a▁b", "中文字符 and ünïcödé", "\x00\x1c", " " * 40, "Ａｂｃ ﬁ", "same text", "same text"]


@pytest.fixture(scope="module")
def encoder():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def messy(spark):
    long = " ".join(f"word{k % 977} and more, so." for k in range(40_000))
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id here"), (None, None), (3, "another text"), (3, "another text"), (90, long), (91, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return stored(df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES if c != "text"]).repartition(3))


# 13: harmonic packing


def layout_of(df):
    """Checks of any layout; pieces by (id, start)."""
    got = df.collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    padding = sum(2048 - n if n & (n - 1) else 0 for n in (sum(p[1] for p in pieces) for pieces in bins.values()))
    return got, padding, len(bins)


def plain_pieces(encoder, docs):
    """Ids per document, cut by nothing."""
    return [(i, [*encoder.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in docs]


def check_cover(got, want):
    spans = defaultdict(list)
    for r in got:
        spans[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    expected = defaultdict(list)
    for i, ids in want:
        expected[i, len(ids)].append(ids)
    assert spans.keys() == expected.keys()
    for key, pieces in spans.items():
        choices = [Counter()] if not expected[key] else []
        cuts = sorted({(s, n) for s, n, _ in pieces})
        assert sum(n for _, n in cuts) == key[1] and all(cuts[k][0] + cuts[k][1] == cuts[k + 1][0] for k in range(len(cuts) - 1))
        choices = Counter((s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for ids in expected[key] for s, n in cuts)
        assert Counter(pieces) == choices


def test_harmonic_query_covers_all_documents(spark, docs, encoder):
    got, padding, bins = layout_of(QUERIES["op13_harmonic_packing"](spark, SMALL))
    want = plain_pieces(encoder, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    check_cover(got, want)
    total = sum(len(ids) for _, ids in want)
    # A full bin is at most eight short; one bin of the rest may be any way off.
    assert padding <= total / 256 + 2048


def test_harmonic_messy_rows(messy, encoder):
    df = harmonic.harmonic_pack(messy).withColumnRenamed("id", "doc_id")
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    got, _, _ = layout_of(df)
    check_cover(got, plain_pieces(encoder, [tuple(r) for r in messy.select("doc_id", "text").collect()]))
    assert harmonic.harmonic_pack(messy.limit(0)).count() == 0


def test_harmonic_sequences_hold_the_ids(spark, encoder):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["alpha", "beta,", "gamma."]) for _ in range(rng.choice([3, 40, 700, 5000])))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    layout = stored(harmonic.harmonic_pack(docs))
    packed = {r["sequence_id"]: r["ids"] for r in harmonic.harmonic_sequences(docs, layout).collect()}
    rebuilt = defaultdict(dict)
    for r in layout.collect():
        rebuilt[r["id"]][r["start"]] = packed[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
    for i, ids in plain_pieces(encoder, rows):
        assert [x for s in sorted(rebuilt[i]) for x in rebuilt[i][s]] == ids


@pytest.mark.parametrize("capacity, waste", [(2048, 1 / 256), (2048, 0), (64, 0), (100, 0.05), (1, 0)])
def test_cut_table(capacity, waste):
    allowed = set(harmonic.class_lengths(capacity, waste))
    best = [0]
    for length in range(1, capacity + 1):
        best.append(min(best[length - a] + 1 for a in allowed if a <= length))
    for length, pieces in enumerate(harmonic.cut_table(capacity, waste)):
        assert sum(pieces) == length and set(pieces) <= allowed and len(pieces) == best[length]


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 400), max_size=20))
@settings(max_examples=150, deadline=None)
def test_plan_rest_places_every_rank_once(histogram):
    rows = harmonic.plan_rest(histogram, 64)
    filled, seen = defaultdict(list), Counter()
    starts = sorted((r[0], r[1]) for r in rows.tolist())
    for length, n in histogram.items():
        for rank in range(n):
            at = max(k for k, s in enumerate(starts) if s <= (length, rank) and s[0] == length)
            _, first, base, each, offset = rows[at].tolist()
            filled[base + (rank - first) // each].append((offset + (rank - first) % each * length, length))
            seen[length] += 1
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert seen == Counter({k: n for k, n in histogram.items() if n})


def test_ids_equal_the_other_form_of_the_vocabulary(encoder):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    known = byte_bpe.byte_bpe()
    rng = random.Random(1)
    letters = [chr(c) for c in [*range(1, 700), *range(0x2000, 0x2070), *range(0x3000, 0x3040), 0x1F600, 0xE0041]] + ["<|endoftext|>", "'ll", "'S", "   "]
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        assert known.special(text).tolist() == encoder.encode(text, add_special_tokens=False).ids
        assert known.plain(text).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 300_000, "a" * 100_000, "\n" * 200_000, "1" * 100_000])
def test_long_runs_of_one_character(text):
    assert sum(len(byte_bpe.byte_bpe().token_bytes[t]) for t in byte_bpe.byte_bpe().plain(text).tolist()) == len(text)


# 11: token links


def plain_links(rows):
    """The rows of the query from token bytes, sets and loops."""
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # The byte-level alphabet: printable Latin-1 stands for itself, the rest is shifted behind it.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    aligned, weights = [], Counter()
    for i, text in rows:
        if not text:
            aligned.append((i, [], [], None))
            continue
        a_ids, b_ids = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        a_bytes = [bytes(alphabet[c] for c in a_side.id_to_token(t)) for t in a_ids]
        pieces = [b_side.id_to_piece(t) for t in b_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            aligned.append((i, [], [], None))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, a_at, b_at = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            a_stop, b_stop = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append((a_ids[a_at:a_stop], b_ids[b_at:b_stop]))
            a_at, b_at = a_stop, b_stop
        aligned.append((i, a_ids, b_ids, groups))
        weights.update({(a, b) for x, y in groups for a in x for b in y})
    highest = defaultdict(int)
    for (a, _), n in weights.items():
        highest[a] = max(highest[a], n)
    out = []
    for i, a_ids, b_ids, groups in aligned:
        links = [(a, b) for x, y in groups or () for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or ())
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, len(a_ids), len(b_ids), len(groups or ()), len(links), sum(weights[p] == highest[p[0]] for p in links), sum(weights[p] for p in links), digest))
    return out


LINK_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_token_links_query(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op11_token_links"](spark, SMALL).select("doc_id", *LINK_COLUMNS).collect()]
    assert sorted(got) == sorted(plain_links(rows))


def test_token_links_of_many_small_runs(docs, messy, monkeypatch):
    """Several levels of merges, on this process' own functions as tasks would call them."""
    monkeypatch.setattr(token_links, "FAN_IN", 2)
    some = docs.select("doc_id", "text").limit(60).unionByName(messy.where("length(text) < 1000 OR text IS NULL").select("doc_id", "text")).repartition(9)
    some = stored(some)
    rows = [tuple(r) for r in some.collect()]
    got = [tuple(r) for r in token_links.token_links(some).select("id", *LINK_COLUMNS).collect()]
    order = lambda r: (r[0] is None, *map(str, r))
    assert sorted(got, key=order) == sorted(plain_links(rows), key=order)


def test_token_links_edges(messy):
    got = token_links.token_links(messy)
    assert got.count() == messy.count()
    zero = got.where("groups_sha256 = ''").select(*LINK_COLUMNS[:-1]).distinct().collect()
    assert [tuple(r) for r in zero] == [(0,) * 6]
    assert token_links.token_links(messy.limit(0)).count() == 0


def test_pair_weights_agree_with_sets(spark):
    rows = [(1, "the cat sat"), (2, "the cat sat sat"), (3, "a cat"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = {(r["a"], r["b"]): (r["n"], r["best"]) for r in token_links.pair_weights(docs).collect()}
    a = byte_bpe.byte_bpe().plain(" cat")[0]
    mine = [n for (x, _), (n, best) in weights.items() if x == a and best]
    assert mine and mine[0] == 3


@given(st.lists(st.lists(st.tuples(st.integers(0, 1 << 31 - 1), st.integers(1, 9)), max_size=30), max_size=6))
@settings(max_examples=100, deadline=None)
def test_merge_is_a_sum(runs):
    want, made = Counter(), []
    for run in runs:
        own = Counter()
        for key, n in run:
            own[key] += n
        want.update(own)
        keys = np.array(sorted(own), np.int64)
        counts = np.array([own[k] for k in sorted(own)], np.int64)
        back = token_links.unpack_numbers(token_links.pack_numbers(keys, counts))
        assert (back[0] == keys).all() and (back[1] == counts).all()
        made.append((keys, counts))
    keys, counts = token_links.merge_runs(made)
    assert dict(zip(keys.tolist(), counts.tolist())) == want and (np.diff(keys) > 0).all()


# 12: spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    for i, text in rows:
        for found in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = defaultdict(set)
    by_cut = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by_cut[w[:k] + w[k + 1 :]].add(w)
    for cut, members in by_cut.items():
        for x in members | ({cut} & words.keys()):
            for y in members | ({cut} & words.keys()):
                if one_edit(x, y):
                    near[x].add(y)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


VARIANT_COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_query(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op12_spelling_variants"](spark, SMALL).select(*VARIANT_COLUMNS).collect()]
    want = plain_variants(rows)
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[1] for r in want)


def test_spelling_chains_ties_and_split_lists(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(900)]
    words += ["abcde"] * 40 + ["abcdé"] * 16 + ["abcdéx"] * 6 + ["Zbcdé"] * 3 + ["xxxxx"] * 8 + ["xxxxxx"] * 4 + ["xxxxxxx"] * 4
    rng.shuffle(words)
    rows = [(k, " ".join(words[k : k + 50])) for k in range(0, len(words), 50)] + [(None, "lonely lonely lonely"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(plain_variants(rows), key=str)
    assert any(r[2] != r[0] and r[1] != r[2] for r in want)
    for longest in (512, 3, 1):
        got = [tuple(r) for r in spellings.spelling_variants(docs, longest=longest).select(*VARIANT_COLUMNS).collect()]
        assert sorted(got, key=str) == want


@given(st.lists(st.text("abc", min_size=4, max_size=5), max_size=60, unique=True))
@settings(max_examples=200, deadline=None)
def test_scan_finds_each_pair_once(cores):
    cores = sorted(cores)
    got = spellings.scan(cores, 4, True)
    want = [(i, j) for i, a in enumerate(cores) for j, b in enumerate(cores) if len(a) == 4 and one_edit(a, b)]
    assert sorted(got) == want


def test_spelling_messy_rows(messy):
    got = spellings.spelling_variants(messy)
    rows = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in got.select(*VARIANT_COLUMNS).collect()], key=str) == sorted(plain_variants(rows), key=str)
    assert spellings.spelling_variants(messy.limit(0)).count() == 0
