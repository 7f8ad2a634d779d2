"""Each operator against brute force on small documents with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from memloom.llm import bpe, decontaminate, html, media, neardup, quality, shards, substrings, tokenfile, toxicity
from memloom.llm.base import flat, shared_dir

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: Extra columns that clash with names used inside.
SCHEMA = "doc_id long, text string, block int, range string, keys string, n int, n_chars long, rest string"


def some_texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in "th in er ou re st é".split() for b in "an on es ing 's re 12 !".split()]
    base = [" ".join(rng.choice(vocabulary, int(n))) for n in (5, 40, 90, 90, 200, 400)]
    texts = [None, "", " \n\t ", "one", "One", "a b", "A  b", *base]
    for text in base[2:]:
        words = text.split()
        for k in (1, 3, 7):
            copy = list(words)
            for at in rng.integers(0, len(copy), k):
                copy[at] = "Zed"
            texts.append(" ".join(copy))
    texts += [base[4], base[4], base[5] + "\n" + base[3], base[1] + " x " + base[2], "long " * 3000, "x" * 5000, "it's  we'll\n\n'tis don't ''s 'S　é́ 12'3 \r\n end  "]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 101, t, 1, "r", "k", 2, len(t or ""), "z") for i, t in enumerate(some_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    found = collections.defaultdict(list)
    for row in df.collect():
        found[row.doc_id].append(row)
    return found


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- 2


def groups(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        words = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, width):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, width).collect()} == groups(pairs(docs), width)


def test_near_duplicates_of_repeated_and_no_rows(spark, docs, empty):
    assert neardup.near_duplicates(empty, 2).count() == 0
    text = " ".join(f"w{k}" for k in range(60))
    rows = spark.createDataFrame([(5, text), (5, text), (9, text + " x"), (5, "quite other words here"), (None, text), (2, "quite other words here")], "doc_id long, text string")
    found = [(r.doc_id, r.component_id) for r in neardup.near_duplicates(rows, 2).collect()]
    assert sorted(found, key=str) == sorted([(5, 2), (5, 2), (9, 2), (5, 2), (None, None), (2, 2)], key=str)
    kept = neardup.drop_duplicates(docs, 5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in groups(pairs(docs), 5).items() if c == i}


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    expected = {x: r for x, r in root.items() if x != r}
    for most in (20, 1000):
        found = neardup.components(spark.createDataFrame(links, "a long, b long"), most).collect()
        assert {r.node: r.component for r in found} == expected and len(found) == len(expected)


def test_hot_sets_partners_and_buckets_are_spread(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in rng.integers(0, 500, 80)]
    texts = [" ".join(base)] * 12 + [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 80, 4)] + [" ".join(f"y{x}" for x in rng.integers(0, 900, 60)) for _ in range(30)] + ["", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = groups(list(enumerate(texts)), 2)
    assert max(collections.Counter(c for _, c in expected.values()).values()) > 12
    for share in (1, 8, 10**6):  # nothing, some and everything is hot
        monkeypatch.setattr(neardup, "SHARE", share)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows, 2).collect()} == expected


def test_signatures_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(2)
    h = rng.integers(1, 2**63, 3000, dtype=np.uint64)
    first = np.array([0, 900, 900, 905, 3000])
    whole = neardup.superminhash(h, first, 200)
    monkeypatch.setattr(neardup, "ELEMENTS", 70)
    assert np.array_equal(whole, neardup.superminhash(h, first, 200))


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(30):
        pool = rng.integers(1, 2**63, 300, dtype=np.uint64)
        a, b = np.sort(pool[:250]), np.sort(pool[50:])
        s = neardup.superminhash(np.concatenate((a, b)), np.array([0, 250, 500]), 200)
        errors.append((s[0] == s[1]).mean() - 200 / 300)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    tiny = neardup.superminhash(np.array([7], np.uint64), np.array([0, 1, 1]), 200)
    assert sorted(tiny[0].astype(int)) == list(range(200)) and np.isinf(tiny[1]).all()


# ---- 3


def cut(rows, length):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            if seen.setdefault(tuple(words[k : k + length]), i) < i:
                gone[k : k + length] = [True] * length
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("length", [1, 2, 13, 50])
@pytest.mark.parametrize("block", [500, 1 << 20])
def test_repeated_passages(docs, length, block):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept.decode()) for r in substrings.remove_repeats(docs, length, block).collect()}
    assert found == cut(pairs(docs), length)


def test_cut_texts_keep_columns_and_clean_texts(docs, empty):
    found, expected, before = by_id(substrings.cut_repeats(docs, 13, 2000)), cut(pairs(docs), 13), dict(pairs(docs))
    for i, (row,) in found.items():
        assert row.rest == "z" and row.block == 1
        if expected[i][1]:
            assert WORD.findall(row.text) == expected[i][2].split() and row.n_chars == len(row.text)
        else:
            assert row.text == before[i]
    assert substrings.cut_repeats(empty, 13).columns == docs.columns and substrings.remove_repeats(empty).count() == 0


def test_longest_repeats(spark):
    words = [f"w{k}" for k in range(70)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(words[:60])), (3, " ".join(words[30:50]) + " y"), (4, "none of it")], "doc_id long, text string")
    assert {r.doc_id: r.longest for r in substrings.longest_repeats(rows, 13, 200).collect()} == {1: 52, 2: 52, 3: 13}


# ---- 6


def edits(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate((3, 8, 16, 30, 59))] + [(8, None), (9, "  ")]
    texts = [None, "", "v1 v2"]
    for _, item in items[:5]:
        for changes in (0, 1, 3, 6, 12, 20):
            words = item.split()
            for _ in range(changes):
                at, kind = int(rng.integers(0, max(1, len(words)))), rng.integers(3)
                words[at : at + (kind != 0)] = [] if kind == 1 else [str(rng.choice(vocabulary))]
            texts.append(" ".join([*rng.choice(vocabulary, 25), *words, *rng.choice(vocabulary, 25)]).replace("v1", "V1").replace(" v2", ", v2"))
    found = decontaminate.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.distance, r.first_word, r.last_word) for r in found.collect()}
    plain = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    expected = {(i, k): d for i, t in enumerate(texts) for k, q in items if plain(q) and (d := edits(plain(q), plain(t))) <= int(0.2 * len(plain(q)))}
    assert {k: v[0] for k, v in got.items()} == expected
    for (i, k), (d, a, b) in got.items():
        assert edits(plain(dict(items)[k]), plain(texts[i])[a:b]) == d
    assert decontaminate.find(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.find(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


# ---- 1 and 4


@pytest.mark.parametrize(("module", "label", "mod", "rest"), [(quality, "quality", 3, 1), (toxicity, "toxic", 5, 0)])
def test_classifiers(spark, docs, empty, module, label, mod, rest):
    documents, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = module.classify(documents, labels, 3000).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % mod == rest for i in held.doc_id)
    assert held.score.between(0, 1).all() and (held.predicted == (held.score >= 0.5)).all()
    order = np.argsort(np.argsort(held.score.to_numpy()))
    y = held[label].to_numpy()
    assert (order[y == 1].mean() - order[y == 0].mean()) / len(y) + 0.5 > 0.95
    assert module.classify(docs, labels.limit(0)).where("score = 0.5").count() == docs.count()
    assert module.classify(empty, labels).count() == 0


def test_identity_terms_move_no_score():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("aeioubcdfg"), 6))
    pool = [word() for _ in range(300)]
    texts, y = [], []
    for k in range(400):
        bad = k % 2
        words = list(rng.choice(pool, 20)) + (["scum"] if bad else []) + (["women"] if bad and k % 4 == 1 else [])
        texts.append(" ".join(words) + ".")
        y.append(float(bad))
    y = np.array(y)
    plain = toxicity.COUNTERFACTUAL
    gaps = []
    for weight in (0.0, plain):
        toxicity.COUNTERFACTUAL = weight
        model = toxicity.fit(texts, y)
        gaps.append(abs(np.diff(model.scores(*flat(pa.array(["the women here", "the men here"]))))[0]))
    toxicity.COUNTERFACTUAL = plain
    assert gaps[1] < gaps[0] / 2


# ---- 5, 7, 8


def test_media(docs, empty):
    found, again = by_id(media.fingerprint(media.store(docs))), dict(pairs(docs))
    for i, (row,) in found.items():
        data = (again[i] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.to_wav(payload)
        assert (row.media_bytes, row.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and media.from_wav(stored) == payload
        codes, times, frames = plain_fingerprint(payload)
        assert (row.n_frames, row.times, row.codes) == (frames, times, codes)
        assert row.feature == f"{frames}:{len(codes)}:{zlib.crc32(np.array(codes, '<i4').tobytes()):08x}{zlib.crc32(np.array(times, '<i4').tobytes()):08x}"
    assert media.fingerprint(media.store(empty)).count() == 0


def plain_fingerprint(payload):
    """Frame by frame: the peak of each band, and the pairs of peaks with the strongest peak of each of the next frames."""
    signal = [x - 128.0 for x in payload]
    count = max(1, -(-max(len(signal) - media.FRAME, 0) // media.HOP) + 1)
    signal += [0.0] * ((count - 1) * media.HOP + media.FRAME - len(signal))
    peaks, strongest = [], []
    for k in range(count):
        frame = np.array(signal[k * media.HOP : k * media.HOP + media.FRAME], np.float32) * np.hanning(media.FRAME).astype(np.float32)
        heights = np.abs(np.fft.rfft(frame)).astype(np.float32)
        heights[heights < 1e-2] = 0
        tops = [max(range(lo, hi), key=lambda x: (heights[x], -x)) for lo, hi in zip(media.BANDS, media.BANDS[1:])]
        peaks.append([x if heights[x] > 0 else 0 for x in tops])
        strongest.append(max((x for x in peaks[-1] if x), key=lambda x: (heights[x], -x), default=0))
    codes, times = [], []
    for k in range(count):
        for step in range(1, media.FAN + 1):
            if k + step < count and strongest[k + step]:
                for x in peaks[k]:
                    if x:
                        codes.append(x << 12 | strongest[k + step] << 2 | step)
                        times.append(k)
    return codes, times, count


def test_a_tone_peaks_at_its_bin():
    tone = (128 + 100 * np.sin(2 * np.pi * 50 * np.arange(4096) / media.FRAME)).astype(np.uint8)
    bins, strong, first = media.peaks(tone, np.array([0, 4096]))
    assert set(strong[:-1].tolist()) == {50} and first[-1] == len(strong)


def public():
    import public_tokenizers

    return public_tokenizers


def test_bpe_is_tiktoken(docs, empty):
    import tiktoken

    ranks = bpe.ranks(bpe.default_ranks())
    tokenizer = tiktoken.Encoding("own", pat_str=public().PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    before = dict(pairs(docs))
    for row in bpe.encode(docs, bpe.default_ranks()).collect():
        assert row.ids == tokenizer.encode_ordinary(before[row.doc_id] or "") and row.lossless
    for row in bpe.round_trip(docs, bpe.default_ranks()).collect():
        ids = tokenizer.encode_ordinary(before[row.doc_id] or "")
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((before[row.doc_id] or "").encode()).hexdigest())
    back = bpe.decode(bpe.encode(docs, bpe.default_ranks()), bpe.default_ranks())
    assert {r.doc_id: bytes(r.data).decode() for r in back.collect()} == {i: t or "" for i, t in before.items()}
    assert bpe.encode(empty, bpe.default_ranks()).count() == 0


def test_bpe_boundaries_on_random_texts():
    import regex

    pattern, rng = regex.compile(public().PATTERN), np.random.default_rng(9)
    letters = list("aab'strevld ''  \n\t12!?é　\xa0ß") + ["'s", "'re", "'ll", "  "]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 30)))) for _ in range(3000)]
    buf, off = flat(pa.array(texts))
    first, stop, row = bpe.boundaries(buf, off)
    data = buf.tobytes()
    for k, text in enumerate(texts):
        assert [data[a:b].decode() for a, b in zip(first[row[k] : row[k + 1]], stop[row[k] : row[k + 1]])] == pattern.findall(text)


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 5000)
    for n in (0, 1, 63, 64, 1023, 1024, 1025, 5000):
        payload, offsets = tokenfile.pack(ids[:n], bits)
        assert len(payload) == (n // 1024) * 128 * bits + -(-(n % 1024) * bits // 8)
        assert tokenfile.unpack(payload, offsets, n, bits).tolist() == ids[:n].tolist()
        for block in range(len(offsets)):
            assert tokenfile.unpack(payload, offsets, n, bits, block).tolist() == ids[:n][block * 1024 : block * 1024 + 1024].tolist()


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenfile.default_tokenizer())
    path = shared_dir(spark, "ids")
    tokenfile.segments(docs, tokenfile.default_tokenizer()).write.parquet(path)
    found, start = by_id(tokenfile.read_documents(spark.read.parquet(path))), 0
    for i, text in sorted(pairs(docs)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(found[i][0])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = shared_dir(spark, "ids")
    tokenfile.segments(empty, tokenfile.default_tokenizer()).write.parquet(path)
    assert tokenfile.read_documents(spark.read.schema(tokenfile.SCHEMA).parquet(path)).count() == 0


# ---- 9


def test_stored_texts_are_not_shuffled_for_their_slots(spark):
    rows = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where Spark knows no sizes yet
    try:
        placed = shards.write_shards(rows, shared_dir(spark, "shards"))
        assert sorted(r.doc_id for r in placed.collect()) == list(range(50))
        assert "SortMergeJoin" not in placed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shards(spark, docs, empty):
    placed = shards.write_shards(docs.unionByName(docs.limit(3)), shared_dir(spark, "shards"), bucket_bytes=100).collect()
    slots = collections.defaultdict(list)
    for row in placed:
        slots[row.shard].append(row.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(placed) == docs.count() + 3
    again = shards.write_shards(docs.unionByName(docs.limit(3)).repartition(7), shared_dir(spark, "shards"), bucket_bytes=100).collect()
    order = lambda rows: sorted((r.shard, r.slot, r.doc_id, r.text or "") for r in rows)
    assert order(again) == order(placed)
    assert shards.write_shards(empty, shared_dir(spark, "shards")).count() == 0


def test_many_records_are_shuffled_alike_at_any_partitioning(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20000).select(F.when(F.col("id") % 4 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    placed = [sorted((r.shard, r.slot, r.text) for r in shards.write_shards(part, shared_dir(spark, "shards"), bucket_bytes=4000).collect()) for part in (rows.repartition(5), rows.orderBy("text").coalesce(2))]
    assert placed[0] == placed[1] and len(placed[0]) == 20000
    nulls = shards.scatter(rows.where("doc_id is null"), bucket_bytes=400).groupBy("shard", "bucket").count().collect()
    assert len({r.shard for r in nulls}) == 1 and len(nulls) > 5  # the law gives them one shard; they spread over its buckets
    slots = collections.defaultdict(list)
    for shard, slot, text in placed[0]:
        slots[shard].append((slot, int(text[5:])))
    for found in slots.values():
        values = [x for _, x in found]
        assert [k for k, _ in found] == list(range(len(found)))
        assert abs(np.corrcoef(range(len(values)), values)[0, 1]) < 0.15


def test_a_further_shard_only_takes(spark):
    from pyspark.sql import functions as F

    moved = spark.range(20000).select(shards.shard_of(F.col("id"), 16).alias("a"), shards.shard_of(F.col("id"), 17).alias("b")).where("a <> b").collect()
    assert {r.b for r in moved} == {16} and abs(len(moved) - 20000 / 17) < 150


# ---- 10


def test_pages(spark):
    for row in html.op10_html_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = row.html[row.html.index("<article>") : row.html.index("</article>")]
        blocks = [" ".join(entities.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|article)>", article)]
        assert row.text == "\n".join(b for b in blocks if b) and row.n_chars == len(row.text)


PARAGRAPH = "Some words of a paragraph that is long enough to be the text of this page, with more to follow. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p", ""),
        ("<script>var a = '<p>no</p>'</script>", ""),
        ("<nav><a href=x>Home</a></nav><main><h1>T &amp; x</h1><p>" + PARAGRAPH + "</p><p>Of.</p></main><footer>f</footer>", "T & x\n" + PARAGRAPH.strip() + "\nOf."),
        ("<body><div class='menu'><ul><li>a<li>b</ul></div><div id=content><h2>Head</h2><p>" + PARAGRAPH * 3 + "<p>" + PARAGRAPH * 2 + "</div><div class='user-comments'><p>" + PARAGRAPH * 5 + "</div>", None),
        ("<article><p>" + PARAGRAPH + "<aside>No</aside><form><input><p>No</p></form><p>Yes &lt;b&gt;\n  it\tis</p><section id='comments'><p>" + PARAGRAPH + "</p></section></article>", PARAGRAPH.strip() + "\nYes <b> it is"),
        ("plain text\n without tags", "plain text without tags"),
    ],
)
def test_page_shapes(page, text):
    got = html.main_text(page)
    if text is None:
        assert got == "\n".join((("Head"), (PARAGRAPH * 3).strip(), (PARAGRAPH * 2).strip()))
    else:
        assert got == text


# ---- 1 and 4, against enumeration


def test_marginals_are_those_of_all_labellings():
    import itertools

    rng = np.random.default_rng(8)
    first = np.array([0, 1, 1, 4, 12])
    emission, ties = rng.normal(size=12), rng.normal(size=(2, 2))
    good, both = quality.marginals(emission, ties, first)
    for a, b in zip(first, first[1:]):
        n, total, one, two = b - a, 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(emission[a + t] * y for t, y in enumerate(labels)) + sum(ties[x, y] for x, y in itertools.pairwise(labels)))
            total += weight if n else 0
            for t, y in enumerate(labels):
                one[t] += weight * y
                if t + 1 < n:
                    two[t, y, labels[t + 1]] += weight
        if n:
            assert good[a:b] == pytest.approx(one / total) and both[a : b - 1] == pytest.approx(two[:-1] / total)


def test_toxicity_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(3)
    f, n, pairs = 6, 9, 4
    row, place = np.repeat(np.arange(n), 3), rng.integers(0, f, 3 * n)
    pair_row, pair_place, pair_sign = np.repeat(np.arange(pairs), 4), rng.integers(0, f, 4 * pairs), np.tile([1.0, 1.0, -1.0, -1.0], pairs)
    z, x = rng.integers(0, 2, n).astype(float), rng.normal(size=f + 1)

    def loss(v):
        logit = v[f] + np.array([sum(v[place[k]] for k in range(3 * n) if row[k] == r) for r in range(n)])
        change = [sum(v[pair_place[k]] * pair_sign[k] for k in range(4 * pairs) if pair_row[k] == r) for r in range(pairs)]
        return np.mean(np.log1p(np.exp(logit)) - z * logit) + toxicity.RIDGE / 2 * (v[:f] ** 2).sum() + toxicity.COUNTERFACTUAL * np.mean(np.square(change))

    step = 1e-6 * np.eye(f + 1)
    expected = [(loss(x + d) - loss(x - d)) / 2e-6 for d in step]
    assert toxicity.gradient(x, z, row, place, pair_row, pair_place, pair_sign, pairs) == pytest.approx(expected, abs=1e-5)


def test_neutral_mentions_are_not_toxic():
    """Groups are named in most toxic and few clean training texts; fewer neutral texts that name them are rejected under the penalty."""
    rng = np.random.default_rng(4)
    pool = ["".join(rng.choice(list("aeioubcdfg"), 6)) for _ in range(200)]
    terms = ["women", "muslims", "immigrants", "jews", "gay"]
    sentence = lambda *more: " ".join([*rng.choice(pool, 12), *more]) + "."
    texts = [sentence(*(["scum"] if k % 3 else []), str(rng.choice(terms))) if k % 2 else sentence() for k in range(600)]
    y = np.array([float(k % 2) for k in range(600)])
    neutral = [sentence(t) for t in terms * 40]
    plain, rates = toxicity.COUNTERFACTUAL, []
    for weight in (0.0, plain):
        toxicity.COUNTERFACTUAL = weight
        model = toxicity.fit(texts, y)
        rates.append(model.scores(*flat(pa.array(neutral))).mean())
    toxicity.COUNTERFACTUAL = plain
    assert rates[1] < rates[0]


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_fitted_classifiers_score_every_row(spark, docs, module, label):
    from memloom.llm.learn import labelled

    texts = [("good words stand here. " * 5 if k % 2 else "bad!!! $$$ 99 ## scum ") + f"x{k}" for k in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "an older text of 3"), (None, "no id"), (200, None), (201, ""), (202, "long " * 40000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(3, None), (7, 0), (None, 1)], f"doc_id long, {label} int")
    found = module.classify(frame, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    one = labelled(frame, labels, label, module.DIVISOR, module.REST)
    again = labelled(frame.repartition(5), labels.repartition(3), label, module.DIVISOR, module.REST)
    assert one[0] == again[0] and one[1].tolist() == again[1].tolist()
    same = {r.score for r in module.classify(frame, labels).where("doc_id in (200, 201)").collect()}
    assert len(same) == 1
