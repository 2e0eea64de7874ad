"""Each corpus operator against a direct implementation, and its defined corner cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from docflow.llm import decontam, exact_dedup, jaccard_tree, langid, pii, substring, token_files, toxicity, warc
from docflow.llm.bpe import BoundaryEncoder, Decoder, decode, encode
from docflow.llm.components import components
from docflow.llm.scratch import scratch_dir

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   # Names that operators use inside.
                   *[StructField(c, StringType()) for c in ("keep_id", "digest", "h", "id", "node", "spans", "ids", "c0", "row", "salt")]])
LONG = " ".join(f"w{i}" for i in range(30_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", *["x"] * 10) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    rows = [(1, None), (2, ""), (None, "a b c"), (None, "a b c"), (4, "a b c"), (5, LONG), (6, LONG), (7, "a b c"), (7, "a b c"), (8, " \t\n"), (9, "é 😀")]
    return docs(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- exact dedup ---------------------------------------------------------------------------------

def test_exact_dedup_cases(odd, empty):
    got = {(r.doc_id, r.text): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect()}
    assert got[1, None] == (2, 2, False) and got[2, ""] == (2, 2, True)
    assert got[None, "a b c"] == (7, 5, False) and got[7, "a b c"] == (7, 5, True) and got[4, "a b c"] == (7, 5, False)
    assert got[5, LONG] == (6, 2, False) and got[8, " \t\n"] == (8, 1, True)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.exact_dedup(odd).columns == [*[c for c in odd.columns if c != "keep_id"], "keep_id", "group_size", "kept"]


def test_exact_dedup_compares_contents(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "bb", "cc", "ddd", "e", "hot", "hot", "hot"])) for i in range(400)]
    poor = lambda text: F.encode(F.length(text).cast("string"), "utf-8")     # many texts for one digest
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs(spark, rows).repartition(7), digest=poor).collect()}
    for i, t in rows:
        own = [k for k, x in rows if x == t]
        assert got[i] == (max(own), len(own))


def test_one_row_of_each_text_stays(spark, odd, empty):
    poor = lambda text: F.encode(F.length(text).cast("string"), "utf-8")
    twice = docs(spark, [(None, "q"), (None, "q"), (None, "r"), (3, "s"), (3, "s"), (2, "s")] * 3).repartition(5)
    both = odd.unionByName(twice)
    want = sorted([(2, ""), (7, "a b c"), (6, LONG), (8, " \t\n"), (9, "é 😀"), (-1, "q"), (-1, "r"), (3, "s")])
    for digest in (exact_dedup.sha256_digest, poor):
        left = exact_dedup.distinct_texts(both, digest=digest)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in left.collect()) == want
    assert left.columns == [c for c in both.columns if c != "keep_id"]
    assert exact_dedup.distinct_texts(empty).count() == 0
    assert exact_dedup.distinct_texts(docs(spark, [(1, "a"), (2, "a"), (3, "b")])).count() == 2


# --- tokenizers ----------------------------------------------------------------------------------

PIECES = ["a", "the", "'s", "'", "ll", "  ", " ", "\n", "\t", "é", "É", "中", "😀", "1", "23", ".", "!!", ",", "<|endoftext|>", "<|ENDOFTEXT|>",
          "<|end", "oftext|>", "x", "'RE", " ", "́", "\x1f", "\x85", "ß", "Σ", "ΑΣ", "İ", "\r\n", "_", "\x00", "…", "×", ";", "Ⅷ", "²", " "]


def texts_of(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_boundaries_encode_like_the_library():
    encoder, ref, texts = BoundaryEncoder(BYTE), Tokenizer.from_file(BYTE), texts_of(4000, 2)
    ids, lens = encoder.encode_texts([t.encode() for t in texts])
    ends = np.cumsum(lens)
    for t, s, e in zip(texts, ends - lens, ends):
        assert ids[s:e].tolist() == ref.encode(t, add_special_tokens=False).ids, t
    assert Decoder(BYTE).decode_lists(ids, lens) == texts


def test_decoder_takes_any_ids():
    rng, ref = random.Random(3), Tokenizer.from_file(BYTE)
    lists = [[rng.randrange(50_257) for _ in range(rng.randint(0, 6))] for _ in range(2000)]
    got = Decoder(BYTE).decode_lists(np.array([i for x in lists for i in x]), np.array([len(x) for x in lists]))
    assert got == [ref.decode(x, skip_special_tokens=False) for x in lists]
    assert Decoder(BYTE).decode_lists(np.array([-5, 64, 10**6]), np.array([3])) == ["a"]


def test_bpe_cases(odd, empty):
    got = decode(encode(odd, BYTE), BYTE).collect()
    assert len(got) == odd.count()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert encode(empty, BYTE).count() == 0


def test_word_encoder_is_the_library():
    encoder, ref, texts = token_files.WordEncoder(WORD), Tokenizer.from_file(WORD), texts_of(4000, 4)
    for t, data in zip(texts, encoder.serialised([t.encode() for t in texts], 1)):
        assert np.frombuffer(data, "<u4").tolist() == [*ref.encode(t, add_special_tokens=False).ids, 1], t


def test_token_files_round_trip(spark, odd, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    ref, start = Tokenizer.from_file(WORD), 0
    got = sorted(token_files.token_roundtrip(table, WORD).collect(), key=lambda r: r.start)
    want = sorted(table.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text is not None, r.text))
    for r, d in zip(got, want, strict=True):
        ids = [*ref.encode(d.text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_roundtrip(empty, WORD).count() == 0


def test_word_cache_that_forgets(monkeypatch):
    """A full cache keeps its first words and gives the same ids."""
    monkeypatch.setattr(token_files.WordEncoder, "KEPT", 40)
    encoder, ref, rng = token_files.WordEncoder(WORD), Tokenizer.from_file(WORD), random.Random(8)
    letters = ["a", "be", "the", "é", "1", ".", "!", "-", "x" * 70]
    for _ in range(30):
        texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 40))) for _ in range(5)]
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.serialised([t.encode() for t in texts], 1)]
        assert got == [[*ref.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert all(encoder.starts[c] <= encoder.starts[c + 1] for c in encoder.codes.values()) and max(encoder.codes.values()) < encoder.known


def test_ranges_for_the_dictionary():
    ids = np.arange(5000, dtype="<u4").tobytes()
    part = token_files._range_of(ids, 4096)
    assert len(part) == 4096 and part in ids and ids.index(part) % 4 == 0 and token_files._range_of(ids[:40], 4096) == ids[:40]


def test_short_document_access(spark):
    folder = scratch_dir(spark)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index = token_files.write_tokens(table, folder, WORD)
    one = token_files.read_tokens(spark, folder, index.where("doc_id = 7")).collect()
    text = table.where("doc_id = 7").first().text
    assert np.frombuffer(bytes(one[0].ids), "<u4").tolist() == [*Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids, 1]
    assert spark.read.parquet(f"{folder}/dictionary").first().dictionary       # a dictionary was trained


# --- language ------------------------------------------------------------------------------------

def test_language_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = langid.fit(table, F.col("doc_id") % 4 != 2)
    got = langid.identify(table, filters).join(table.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 2").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_language_of_three_short_texts(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rare = [(-1, "Mae'r gath yn cysgu wrth y ffenestr"), (-2, "Bydd y trên yn cyrraedd yfory"), (-3, "Roedd llyfrau newydd gan yr athrawes")]
    filters = langid.fit(table.unionByName(spark.createDataFrame([(*r, "cy") for r in rare], table.schema)), F.lit(True))
    asked = docs(spark, [(1, "Roedd y gath wrth y ffenestr"), (2, "Bydd yr athrawes yn cysgu"), (3, "llyfrau newydd yn cyrraedd yfory")])
    assert {r.lang_pred for r in langid.identify(asked, filters).collect()} == {"cy"}


def test_language_cases(spark, odd, empty):
    filters = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), F.lit(True))
    got = {(r.doc_id, r.score == 0): r.lang_pred for r in langid.identify(odd, filters).collect()}
    assert got[1, True] == got[2, True] == got[8, True] == "und"
    assert all(p in filters.langs or p == "und" for p in got.values())
    nothing = langid.fit(empty, F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(empty, filters).count() == 0


def test_language_filters_have_no_false_negatives():
    grams = {f"l{i}": np.random.default_rng(i).integers(0, 2**63, 2000).astype(np.uint64) for i in range(11)}
    filters = langid.Filters.build(grams, sorted(grams))
    for i, lang in enumerate(sorted(grams)):
        at = filters.positions(grams[lang])
        for p in at:
            assert (filters.table[p, i // 8] >> (i % 8) & 1).all()
    assert (filters.chance < 0.01).all()


# --- personal data -------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) \
                    or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), no, kind, m.end()))
    return sorted(out)


def test_pii_against_regular_expressions(spark):
    rng = random.Random(5)
    bits = ["a@b.co", "_x@y.zz", "a@b", "@", ".", "1.2.3.4", "256.1.1.1", "0010.0.0.9", "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111",
            "+1 (202) 555-0100", "+", "12", " ", "-", "😀", "é", "x", "+44 20 7946 0958 ", "9", "1.1.1.1.1.1.1.1"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(1500)]
    rows += [(9000, None), (9001, ("a@b.co 10.0.0.1 " * 2000)), (9002, "1" * 50_000), (9003, "a" * 50_000 + "@b"), (9004, "+1" + "." * 50_000)]
    got = {r.doc_id: [(s.start, s.kind_no, s.kind, s.end) for s in r.spans if s.kind in pii.BASE] for r in pii.find_pii(docs(spark, rows)).collect()}
    for i, t in rows:
        assert got[i] == base_spans(t or ""), t


def test_pii_added_kinds_and_scores(spark, empty):
    rows = [(1, "IBAN DE89370400440532013000"), (2, "DE89370400440532013001"), (3, "GB82 WEST 1234 5698 7654 32"), (4, "my ssn 123-45-6789"),
            (5, "part 123-45-6789"), (6, "mail me: a@b.co"), (7, "a@b.co")]
    got = {r.doc_id: {s.kind: (s.text, round(s.score, 2)) for s in r.spans} for r in pii.find_pii(docs(spark, rows)).collect()}
    assert got[1]["iban"] == ("DE89370400440532013000", 1.0) and not got[2] and got[3]["iban"][1] == 0.8
    assert got[4]["ssn"][0] == "123-45-6789" and not got[5]
    assert got[6]["email"][1] == 1.0 and got[7]["email"][1] == 0.8
    assert pii.find_pii(empty).count() == 0


# --- WARC ----------------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    schema = "page_id long, url string, html string, digest string, file string"
    same = "<p>same</p>"
    rows = [(1, "http://a/ü x", same), (2, None, same), (3, "http://b", None), (4, "http://c", ""), (5, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (6, "u", LONG),
            (6, "u", same), (None, "n", same), (7, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "d", "f") for r in rows], schema).repartition(3)
    got = warc.warc_roundtrip(pages).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.payload_bytes): r for r in got}
    for page_id, _, html in rows:
        r, data = by[page_id, len((html or "").encode())], (html or "").encode()
        assert r.payload_digest == __import__("base64").b32encode(hashlib.sha1(data).digest()).decode()
        if html == same and page_id != 6:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 6, None)
        elif page_id == 3:
            assert (r.record_type, r.refers_to) == ("revisit", 4)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)
    assert {r.record_type for r in warc.warc_roundtrip(pages, least=10**6).collect()} == {"response"}
    assert warc.warc_roundtrip(pages.limit(0)).count() == 0


def test_ranges_coalesce():
    from docflow.llm.shards import coalesced
    assert list(coalesced([(0, 10), (10, 5), (40, 5), (1000, 1)], gap=30)) == [(0, 45, [0, 1, 2]), (1000, 1001, [3])]
    assert [m for *_, m in coalesced([(0, 6), (6, 6), (12, 20)], most=12)] == [[0, 1], [2]]


# --- substring dedup -----------------------------------------------------------------------------

def kept_words(rows, window):
    first, out = set(), {}
    for i, t in sorted(rows):
        words = (t or "").split()
        gone = set()
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            if key in first:
                gone |= set(range(k, k + window))
            first.add(key)
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


@pytest.mark.parametrize("window,seed,bits", [(6, 3, 28), (20, 8, 12)])
def test_substring_dedup(spark, window, seed, bits):
    rng = random.Random(window)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randint(window - 1, 3 * window))] for _ in range(8)]
    rows = [(i, " ".join(itertools.chain.from_iterable(rng.choice(passages) if rng.random() < 0.4 else [rng.choice(words)]
                                                       for _ in range(rng.randint(0, 30))))) for i in range(300)]
    rows += [(900, "ha " * 100), (901, "ha ho " * 60), (902, None), (903, rows[5][1]), (904, rows[5][1])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.drop_repeats(docs(spark, rows).repartition(5), window, seed, filter_bits=bits).collect()}
    assert got == kept_words(rows, window)


def test_substring_cases(odd, empty):
    got = collections.defaultdict(list)
    for r in substring.drop_repeats(odd).collect():
        got[r.doc_id].append((r.n_words, r.n_removed))
    assert got[5] == [(30_000, 0)] and got[6] == [(30_000, 30_000)] and got[1] == [(0, 0)] and got[None] == [(3, 0)] * 2
    assert substring.drop_repeats(empty).count() == 0


# --- Jaccard join --------------------------------------------------------------------------------

def classes_of(rows, n, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_classes(spark, monkeypatch, n, percent):
    monkeypatch.setattr(jaccard_tree, "CELL", 16)           # several cells for a key
    rng = random.Random(n)
    words = [f"w{i}" for i in range(900)]
    common, rows = [rng.choice(words) for _ in range(40)], []
    for size in (12, 40, 120):
        for copies in (2, 9, 60):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(copies):
                w = list(base)
                for _ in range(rng.randint(0, max(1, size // 40))):
                    w[rng.randrange(size)] = rng.choice(words)
                rows.append(" ".join(w))
    rows += [" ".join(common + [rng.choice(words) for _ in range(rng.randint(0, 9))]) for _ in range(150)]
    rows += ["", None, "One", "one", "two words", "Two  Words", "a b c", "A B C"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_tree.near_classes(docs(spark, rows).repartition(4), n, percent).collect()}
    assert got == classes_of(rows, n, percent)


@pytest.mark.parametrize("cell,small", [(1024, 16), (4, 1)])
def test_jaccard_signatures_of_several_lengths(spark, monkeypatch, cell, small):
    """Sets around the sizes at which signatures double, in cells and trees of any size."""
    monkeypatch.setattr(jaccard_tree, "CELL", cell)
    monkeypatch.setattr(jaccard_tree, "SMALL", small)
    rng = random.Random(cell)
    words, rows = [f"w{i}" for i in range(5000)], []
    for size in (530, 1060, 2100):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(14):
            w = base[:rng.randint(int(0.8 * size), size)]
            for _ in range(rng.randint(0, size // 60)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_tree.near_classes(docs(spark, rows).repartition(4), 3, 90).collect()}
    assert got == classes_of(rows, 3, 90)


def test_jaccard_sets_two_levels_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard_tree, "LIKELY", 0)          # trees alone
    words = [f"v{i}" for i in range(4200)]
    rows = [(1, " ".join(words[:512])), (2, " ".join(words[:1025])), (3, " ".join(words[2000:2500])), (4, " ".join(words[2000:4200]))]
    for percent, want in ((45, {1: 1, 2: 1, 3: 3, 4: 4}), (20, {1: 1, 2: 1, 3: 3, 4: 3})):
        got = {r.doc_id: r.component_id for r in jaccard_tree.near_classes(docs(spark, rows), 1, percent).collect()}
        assert got == want
    for percent in (0, 101):
        with pytest.raises(ValueError):
            jaccard_tree.near_classes(docs(spark, rows), 1, percent)


def test_jaccard_cases(odd, empty):
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard_tree.near_classes(odd).collect())
    assert got[:2] == [(0, 1, 4)] * 2 and (1, 0, 1) in got and (2, 0, 2) in got and (6, 29_998, 5) in got and got.count((7, 1, 4)) == 2
    assert jaccard_tree.near_classes(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), scratch_dir(spark)).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {k: 1 for k in range(2, 60)}


# --- decontamination -----------------------------------------------------------------------------

def test_decontamination(spark, monkeypatch):
    table, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.item_id: decontam.words_of(r.text.encode()) for r in items.collect()}
    grams = collections.defaultdict(set)
    for i, w in texts.items():
        for s in decontam.shingled(w):
            grams[s].add(i)
    rng = random.Random(6)
    planted = [(10_000 + i, " ".join(rng.choice(["aa", "bb", "the"]) for _ in range(200)) + " " + " ".join(t.upper().decode() for t in w) + "! tail")
               for i, w in texts.items()]
    half = [(20_000 + i, " ".join(t.decode() for t in w[:len(w) // 2])) for i, w in texts.items()]
    both = table.select("doc_id", "text").unionByName(spark.createDataFrame(planted + half, "doc_id long, text string"))
    want = set()
    for r in both.collect():
        hits = collections.Counter(i for s in decontam.shingled(decontam.words_of((r.text or "").encode())) for i in grams.get(s, ()))
        want |= {(r.doc_id, i) for i, n in hits.items() if n >= 0.99 * len(decontam.shingled(texts[i]))}
    for shard in (decontam.SHARD_ITEMS, 13):
        monkeypatch.setattr(decontam, "SHARD_ITEMS", shard)
        got = {(r.doc_id, r.item_id) for r in decontam.contaminated(both, items).collect()}
        assert got == want and {(10_000 + i, i) for i in texts} <= got and not any(20_000 <= d < 30_000 for d, _ in got)


def test_block_search_is_exhaustive():
    rng = random.Random(7)
    words = [f"w{i}".encode() for i in range(60)]
    items = [(i, b" ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(50)]
    split = [decontam.words_of(t) for _, t in items]
    df = collections.Counter(t for w in split for t in set(w))
    index = decontam.Index(items, df, 50, 15.0)
    queries = [sorted({index.terms[t] for t in rng.sample(words, 25) if t in index.terms}) for _ in range(80)]
    passage = np.repeat(np.arange(80), [len(q) for q in queries])
    for threshold in (0.3, 0.6, 0.9):
        p, i, s = index.search(passage, np.concatenate([np.array(q) for q in queries]), threshold)
        got = {(a, b): c for a, b, c in zip(p.tolist(), i.tolist(), s.tolist())}
        for q, terms in enumerate(queries):
            for item in range(len(index.ids)):
                own = sum(index.post_score[k] for t in terms for k in range(index.post_starts[t], index.post_starts[t] + index.post_lens[t])
                          if index.post_item[k] == item)
                assert ((q, item) in got) == (own >= threshold - 1e-9)


def test_decontamination_finds_edited_items(spark):
    items = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").limit(60)
    texts = {r.item_id: [w.decode() for w in decontam.words_of(r.text.encode())] for r in items.collect()}
    rng, edited, clean = random.Random(8), [], []
    around = lambda w: " ".join([*rng.choices(["aa", "bb", "the"], k=rng.randint(0, 90)), *w, *rng.choices(["aa", "bb", "the"], k=40)])
    for i, w in texts.items():
        cut = len(w) - max(1, round(len(w) / 3))
        for part in (range(cut), range(cut, len(w))):
            for n in (1, 2):
                at = rng.sample(part, n)
                edited += [(i, around([f"new{k}" if k in at else x for k, x in enumerate(w)])), (i, around([x for k, x in enumerate(w) if k not in at])),
                           (i, around([y for k, x in enumerate(w) for y in ([x, f"new{k}"] if k in at else [x])]))]
        middle = [f"new{k}" if k == cut // 2 else x for k, x in enumerate(w)]
        edited.append((i, around([*middle[:cut], *["cc"] * 15, *w[cut:]])))
        clean += [around([*w[:cut], *[f"other{k}" for k in range(len(w) - cut)]]), around(w[cut:]), around([f"new{k}" if k % 3 == 0 else x for k, x in enumerate(w)]),
                  around(rng.sample(w, len(w)))]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(edited)] + [(100_000 + k, t) for k, t in enumerate(clean)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(k, i) for k, (i, _) in enumerate(edited)}


def test_lowered_threshold_keeps_items_whose_best_words_are_missing():
    words = [b"rare%d" % i for i in range(4)] + [b"common%d" % i for i in range(20)]
    index = decontam.Index([(1, b" ".join(words))], {w: 1 if w.startswith(b"rare") else 900 for w in words}, 1000, 24.0)
    terms = np.unique(index.term_numbers(words[4:]))
    least = index.thresholds(decontam.THRESHOLD, decontam.OVERLAP)
    assert not len(index.search(np.zeros_like(terms), terms, decontam.THRESHOLD)[1]) and len(index.search(np.zeros_like(terms), terms, least)[1])


def test_decontamination_cases(spark, odd, empty):
    items = spark.createDataFrame([(1, "A b, c"), (2, None), (3, "!"), (None, "é 😀")], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontam.contaminated(odd, items).collect())
    assert got == sorted([("None", "1")] * 2 + [("4", "1"), ("7", "1"), ("7", "1"), ("9", "None")])
    assert decontam.contaminated(empty, items).count() == 0 and decontam.contaminated(odd, items.limit(0)).count() == 0


# --- toxicity ------------------------------------------------------------------------------------

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = toxicity.fit(table, labels, F.col("doc_id") % 5 != 0)
    got = toxicity.score(table.where("doc_id % 5 = 0"), net).join(labels, "doc_id").collect()
    toxic = [r.predicted for r in got if r.toxic]
    clean = [r.predicted for r in got if not r.toxic]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_toxicity_pools_whole_texts_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    net = toxicity.Net.fresh([np.arange(1 << toxicity.BUCKET_BITS)] * 2)
    counts = np.array([0, 1, 2, 3, 500, 0, 90])
    ids = rng.integers(0, 1 << toxicity.BUCKET_BITS, (int(counts.sum()), 2)).astype(np.int32)
    whole = net.logits(ids, counts)
    monkeypatch.setattr(toxicity, "STEP", 17)
    assert np.allclose(net.logits(ids, counts), whole, atol=1e-4)
    ends = np.cumsum(counts)
    alone = [net.logits(ids[s:e], np.array([e - s]))[0] for s, e in zip(ends - counts, ends)]
    assert np.allclose(alone, whole, atol=1e-4)


def test_toxicity_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (5, 0), (5, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.where("toxic = 1")):
        net = toxicity.fit(odd, known, F.lit(True))
        got = toxicity.score(odd, net).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert toxicity.without_toxic(odd, net).columns == odd.columns
        assert toxicity.score(empty, net).count() == 0
