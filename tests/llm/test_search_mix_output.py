import hashlib
import io
import random
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import chat_format, decontaminate, mixing, token_records
from tallyspark.llm.queries import MIXTURE, default_tokenizer

from .conftest import prose


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence_equals_dynamic_programming():
    draw = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 9), (70, 40), (130, 200), (3, 0)):
        a, b = draw.integers(0, 6, n), draw.integers(0, 6, m)
        assert decontaminate.common_subsequence(a, b) == lcs(a.tolist(), b.tolist())


ITEMS = [prose(1000 + i, 3).replace("\n", " ") for i in range(12)]


def paraphrase(text):
    words = text.split()
    return " ".join("other" if i % 4 == 1 and i < len(words) - 6 else w for i, w in enumerate(words))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ITEMS)] + [(50, None), (51, ""), (None, ITEMS[3])], "item_id bigint, text string")


@pytest.fixture(scope="module")
def planted(docs_of, odd):
    rows = [(500 + i, f"{prose(2000 + i, 12)} {t.upper() if i % 2 else t} {prose(3000 + i, 12)}") for i, t in enumerate(ITEMS)]
    rows += [(600, f"{prose(4000)} {paraphrase(ITEMS[5])} {prose(4001)}"), (601, ITEMS[0]), (602, prose(4002, 90)), (603, " ".join(ITEMS[1].split()[:8]))]
    return odd.unionAll(docs_of(rows))


def test_items_are_found_and_clean_texts_left(planted, bench):
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(planted, bench).collect()}
    assert found == {(500 + i, i) for i in range(12)} | {(503, None), (600, 5), (601, 0)}
    kept = decontaminate.keep_clean(planted, bench)
    assert kept.schema == planted.schema
    gone = {d for d, _ in found}
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in planted.collect() if r.doc_id not in gone)


def plain_index(items):
    rank = 4
    fold = np.random.default_rng(6).normal(size=((1 << decontaminate.BITS) + 1, rank)).astype(np.float32)
    return decontaminate.Index(fold, items, np.zeros((len(items), rank), np.float32), np.arange(len(items)), 0.65, 0.8, 0.5,
                               decontaminate.runs_of(items), decontaminate.words_of(items), np.array([len(i.words) for i in items]))


def test_a_run_that_all_items_share():
    """Items that begin alike, and one very long item: what is found equals a look at every item by itself."""
    opening = " ".join(prose(5000, 3).split()[:6])
    texts = [f"{opening} {prose(5100 + i, 3)}" for i in range(300)] + [prose(5500, 600)]
    items = [decontaminate.Item(i, h, h[-5:]) for i, t in enumerate(texts) for h in [decontaminate._hashes(t)]]
    index = plain_index(items)
    docs = [f"{prose(6000 + i, 30)} {opening} {prose(6100 + i, 30)}" for i in range(20)]
    docs += [f"{prose(6200, 9)} {texts[7]} {prose(6201, 9)} {texts[250]}", texts[300], opening]
    block = next(decontaminate.blocks(pa.array(docs)))
    start = time.process_time()
    found = {(t, k) for t, k, *_ in decontaminate.found_in(block, index)}
    assert time.process_time() - start < 5 and found == {(20, 7), (20, 250), (21, 300)}
    for t, text in enumerate(docs[18:], 18):
        own = decontaminate._hashes(text).tolist()
        for k in (0, 7, 250, 299, 300):
            assert ((t, k) in found) == (lcs(items[k].words.tolist(), own) >= 0.8 * len(items[k].words) if k < 300 else t == 21)


def test_a_whole_item_is_compared_once(monkeypatch):
    """A long text that is an item: passages no nearer than the one that holds the whole of it are not compared again."""
    text = prose(5900, 400)
    words = decontaminate._hashes(text)
    calls, compare = [], decontaminate.common_subsequence
    monkeypatch.setattr(decontaminate, "common_subsequence", lambda a, b: calls.append(len(a)) or compare(a, b))
    found = decontaminate.found_in(next(decontaminate.blocks(pa.array([text, text]))), plain_index([decontaminate.Item(1, words, words[-5:])]))
    assert [(t, k, share) for t, k, _, share, _ in found] == [(0, 0, 1.0), (1, 0, 1.0)] and calls.count(len(words)) <= len(words) / 16


def test_answer_column_decides_paraphrases(spark, planted):
    items = spark.createDataFrame([(5, ITEMS[5], "words that are not there")], "item_id bigint, text string, answer string")
    assert {r.doc_id for r in decontaminate.leaks(planted, items, verbatim=0.9).collect()} == {505}


def test_latent_recall(planted, bench):
    """Against brute-force cosines on whole TF-IDF vectors: passages near an item are near in the latent space."""
    import pyarrow as pa

    sent = next(decontaminate.indexes(planted, bench))
    index = sent.value
    frequency, total = decontaminate.passage_frequencies(planted)
    idf = np.log((total + 1) / (frequency + 1)) + 1e-3
    texts = [r.text for r in planted.collect()]
    items = [np.bincount(decontaminate.feature(i.words), minlength=1 << decontaminate.BITS) * idf for i in index.items]
    near = hit = 0
    for block in decontaminate.blocks(pa.array(texts)):
        words = block.words()
        latent, starts, text = decontaminate.folded(words, index)
        for p, s in enumerate(starts):
            own = words.hash[s : min(s + 2 * decontaminate.STRIDE, words.bounds[text[p] + 1])]
            x = np.bincount(decontaminate.feature(own), minlength=1 << decontaminate.BITS) * idf
            for k, y in enumerate(items):
                if x @ y >= 0.6 * np.linalg.norm(x) * np.linalg.norm(y):
                    near += 1
                    hit += (latent[p] @ index.pieces[index.owner == k].T).max() >= index.cosine
    assert near > 12 and hit >= 0.9 * near


def test_nothing_to_search(none, bench, odd):
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.keep_clean(odd, bench.where("text is null")).count() == odd.count()


def test_raking_meets_the_targets():
    tokens = np.random.default_rng(1).integers(0, 1000, (4, 3, 2)).astype(float)
    goals = [np.array([0.25] * 4), np.array([0.3, 0.3, 0.4]), np.array([0.5, 0.5])]
    w = mixing.rake(tokens, goals, 0.2, 60)
    assert np.allclose(w.sum((1, 2)), goals[0], atol=1e-6) and np.allclose(w.sum((0, 1)), goals[2], atol=1e-6)
    assert (w * 0.2 * tokens.sum() <= tokens + 1e-6).all()
    assert mixing.rake(np.zeros((2, 2, 2)), [np.ones(2) / 2] * 3, 0.5, 5).sum() == 0


def test_mixture(odd, none, docs_of):
    docs = odd.unionAll(docs_of([(1000 + i, prose(i, 6), "en" if i % 3 else "de", f"src{i % 4}") for i in range(60)]))
    rows = mixing.weighted(docs, MIXTURE).collect()
    assert len(rows) == docs.count() and all(0 <= r["__rate"] <= 1 for r in rows)
    assert all(r["__rate"] == 1 and r["__kept"] for r in rows if r["__tokens"] == 0)
    for r in rows:
        u = int(hashlib.md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest()[:13], 16) / 16**13
        assert r["__kept"] == (u < r["__rate"]) and r["__tokens"] == len((r.text or "").encode().split())
    kept = mixing.mix(docs, MIXTURE)
    assert kept.schema.names == docs.schema.names and kept.count() == sum(r["__kept"] for r in rows)
    assert mixing.mix(none, MIXTURE).count() == 0


TURNS = [
    (1, 0, "user", "a <|im_end|> b \\n \\"), (1, 1, "assistant", "<|im_start|>assistant\nok"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (1, 4, "user", "tail <\\| <\\\\|"), (2, 0, "assistant", "é\U0001f600\\"), (2, 0, "assistant", "é\U0001f600\\"), (3, 0, "us\ner\\n<|", "x"),
    (3, 1, None, None), (None, None, "assistant", "y"), (4, 5, "assistant", "long " * 50_000), (4, 4, "system", "<"), (5, 0, "assistant\n", "|im_end|>"),
]


def brute_chat(turns):
    by = {}
    for c, n, role, text in turns:
        by.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for c, rows in by.items():
        rows.sort()
        loss = "".join(t for _, _, r, t in rows if r == "assistant")
        out.append((c, len(rows), sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_chat_round_trip(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, formatted string, loss string, example int"
    turns = spark.createDataFrame([(*t, "x", "y", 9) for t in TURNS], schema)
    examples = chat_format.examples(turns)
    rows = chat_format.digests(examples).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == brute_chat(TURNS)
    found = examples.where("conv_id = 1").orderBy("example").collect()
    assert [r.example for r in found] == [0, 1, 2] and [r.loss_chars > 0 for r in found] == [True, False, False]
    assert all(b.formatted.startswith(a.formatted) for a, b in zip(found, found[1:]))
    assert found[0].formatted.count("<|im_start|>") == 2 and found[0].formatted.count("<|im_end|>") == 2
    assert {r.conv_id: r.formatted_chars for r in rows}[1] == sum(len(r.formatted) for r in found)
    assert chat_format.digests(chat_format.examples(turns.limit(0))).count() == 0


@pytest.fixture(scope="module")
def written(odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("records"))
    return token_records.write_records(odd, folder, default_tokenizer(), shards=3)


def test_records_equal_the_tokenizer(written, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    want, start = [], 0
    order = sorted(odd.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    for r in order:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_records.read_digests(written).collect()), key=lambda r: r[1]) == want


def test_index_gives_any_record(written):
    for path, records in ((r.path, r.records) for r in written.collect()):
        straight = list(token_records.read_shard(path))
        picked = token_records.read_at(path, list(range(records))[::-1])
        assert [(i, ids.tolist()) for i, ids in picked] == [(i, ids.tolist()) for i, ids in straight[::-1]]


def test_damage_is_noticed():
    record = token_records.frame(token_records.pack(7, np.array([1, 2, 70_000]), 4))
    doc_id, ids = token_records.unpack(token_records.read_record(io.BytesIO(record)))
    assert doc_id == 7 and ids.tolist() == [1, 2, 70_000] and struct.unpack("<Q", record[:8])[0] == len(record) - 16
    for i in range(len(record)):
        with pytest.raises(ValueError):
            token_records.read_record(io.BytesIO(record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :]))
    with pytest.raises(ValueError):
        token_records.read_record(io.BytesIO(record[:-1]))


def test_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    encoder = token_records.Encoder(default_tokenizer())
    texts = ["It's <|endoftext|> x<|startoftext|>y", "é ́a   　b", "A\tB\x0bC\x1cD E", "don't 'll''s ... 12a3", "İ ẞ ΑΣ Σ.", "", " ",
             "End. END!!! e.n.d. 12.5 5%%% (x) x). it's. 's. 'S, É. É! a* *a* ** .", "<|ENDOFTEXT|> <|endoftext|>. A<|", "E\u0301. E\u0301 1\u0301. a.\u0301"]
    for t, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_new_words_go_to_the_tokenizer_together():
    """Few calls' worth of texts for many words, and the ids of each as if it came alone."""
    encoder = token_records.Encoder(default_tokenizer())
    texts = [prose(7700, 300), "a|b | || x|", "|", "\u2223 \uff5c \u00a6 e|\u0301", "<|endoftext|> 's it's \u0301a", "",
             "ÀÖØÞ àöøÿ×÷ ß. Éa&&& É!! 'É É' École, école École\u0301 don't... a.b x%%% $ $$x ... İ. ÿ\u0308"]
    given, plain = [], encoder.encoded
    encoder.encoded = lambda batch: given.extend(batch) or plain(batch)
    for t, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert len(encoder.number) > 2_000 and len(given) < 40
    encoder.straight = None
    encoder.clear()
    assert [i.tolist() for i in encoder.encode([t.encode() for t in texts])] == [
        encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.encode([]) == [] and [len(i) for i in encoder.encode([b"", b" "])] == [0, 0]


def test_no_records(none, tmp_path):
    manifest = token_records.write_records(none, str(tmp_path), default_tokenizer(), shards=2)
    assert token_records.read_digests(manifest).count() == 0


def test_short_verbatim_items_of_a_full_block(spark, docs_of):
    """2,000 items of 3 to 60 words, each in a place of its own: all copies are found, of every length."""
    draw = random.Random(21)
    known = ["".join(draw.choice("aeioulmnrst") for _ in range(draw.randint(3, 7))) for _ in range(20_000)]

    def words(n):
        return [known[int(20_000 * draw.random() ** 3)] for _ in range(n)]

    sizes = [3, 15, 16, 17, 18, 19, 25, 40, 60]
    items = [words(sizes[i % len(sizes)]) for i in range(2_000)]
    rows = [(i, " ".join([*words(draw.randint(0, 80)), *item, *words(draw.randint(0, 80))])) for i, item in enumerate(items)]
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(rows), bench).collect()}
    missed = {n: sum((i, i) not in found for i in range(2_000) if len(items[i]) == n) for n in sizes}
    assert missed == dict.fromkeys(sizes, 0)
    assert all(i == j or len(items[j]) == 3 for i, j in found)
