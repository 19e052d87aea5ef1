import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from memloom.llm import encode as E
from memloom.llm.pack import assign, pack

PARTS = ["hello world", " ", "\n", "  ", "it's", "'st", "don't.", "日本語のテスト。次の文、", "中文。", "ー。", "・。", "<|endoftext|>", "\t", "　", "𝒎𝒂", "123 456", "a" * 70, "é́", "\r\n", "\x00", "、", "x y ", "🙂 "]
SCRIPTS = ["Планировщик очищает", "очереди, ", "جدول المهام", "، يحذف ", "ตารางงานจะล้าง", "คิว ", "योजना ", "कार्य।", "תור עבודה", "스케줄러가 ", "큐를.", "Ελληνικά; ", "١٢٣", "½ Ⅷ ", "'s", "''re", "\u180e", "\x1c", "\u200b", "ǅ", "\U0001e900"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS + SCRIPTS) | st.text(max_size=12), max_size=60).map("".join).map(lambda s: s.encode("utf-8", "ignore").decode()), st.lists(st.floats(0, 1), max_size=12), st.integers(0, 7))
def test_joins_are_repaired_to_the_whole(text, where, rare):
    enc = E.encoding()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    places = np.flatnonzero(E.sure(E.kinds()[points])) if len(points) else np.zeros(0, np.int64)
    bounds = sorted({0, len(text), *(int(x * len(text)) for x in where)})  # cut anywhere
    if not text:
        return
    parts = E.segments(text, bounds, places, lambda chunk: hash(chunk) % 8 >= rare)
    assert "".join(text[s:e] for _, s, e, _ in parts) == text
    assert [i for _, s, e, _ in parts for i in enc.encode_ordinary(text[s:e])] == enc.encode_ordinary(text)
    for common, s, e, k in parts:  # what a chunk is encoded to goes by the chunk alone
        if common:
            chunk = text[bounds[k] : bounds[k + 1]]
            own = np.flatnonzero(E.sure(E.kinds()[np.frombuffer(chunk.encode("utf-32-le"), np.uint32)]))
            assert (s - bounds[k], e - bounds[k]) == (own[0], own[-1])


def test_every_script_is_cut_and_shared():
    dice = random.Random(3)
    for letters in ("планировщикчезт", "جدولمهايحذفكشثت", "योजनासभीकार्य", "スケジュラはキを空にする", "스케줄러가큐를비운다", "ตารางนจะล้คิว"):
        text = " ".join("".join(dice.choice(letters) for _ in range(dice.randint(2, 7))) for _ in range(600))
        one, other = "x " + text, text[11:]
        chunks = []
        for t in (one, other):
            (_, whole, starts, at, _), = E._pieces([t])
            b = E._bounds(0, len(t), at)
            chunks.append({whole[s:e] for s, e in zip(b[:-1], b[1:])})
        assert len(chunks[0]) > 3 and len(chunks[0] & chunks[1]) >= 0.5 * len(chunks[0])


def test_filter_goes_by_the_number_of_chunks(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("xxhash64(id) as key", "if(id < 100, 64L, 2L) as n")
    whole = E._filter(rows)
    assert len(whole) * 8 >= 5000 * E.BITS_A_KEY
    held = lambda bits, k: all(bits[h >> 3] >> (h & 7) & 1 for h in ((r["key"] % (1 << 64)) % (len(bits) * 8) for r in k.collect()))
    assert held(whole, rows)
    monkeypatch.setattr(E, "MOST_BITS", 1 << 16)
    few = E._filter(rows)
    assert len(few) * 8 <= 1 << 16 and held(few, rows.where("n = 64"))


def test_hot_chunks_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(E, "HOT", 3)
    test_corpus_with_shared_chunks(spark)


def test_corpus_with_shared_chunks(spark):
    base = " ".join(f"word{k} runs over the {k} hills." for k in range(400))
    rows = [(k, base[: 2000 + 500 * k] + f" end {k}") for k in range(8)] + [(20, None), (21, ""), (22, "  "), (23, base), (24, base), (25, "日本語。" * 300), (0, base[:2000] + " end 0"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "pos": F.lit("p"), "key": F.lit(2)})
    got = E.encode_corpus(df, "doc_id", "text").collect()
    want = {i: E.encoding().encode_ordinary(t or "") for i, t in rows if i is not None}
    assert len(got) == len(want) and {r["doc_id"]: list(r["ids"]) for r in got} == want


def test_json_vocabulary_agrees():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in PARTS + ["".join(PARTS)]:
        assert t.encode(text, add_special_tokens=False).ids == E.encoding().encode_ordinary(text)


def test_encode_nothing(spark):
    assert E.encode_corpus(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200))
def test_assign_never_overfills(sizes):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    k = assign(sizes, 100)
    if len(sizes):
        fill = np.bincount(k, weights=sizes)
        assert fill.max() <= 100 and len(fill) <= 2 * -(-sizes.sum() // 100)


def test_pack_places_every_token_once(spark):
    rows = [(k, (k * 37) % 900) for k in range(500)] + [(900, None), (901, 0), (None, 5), (902, 4096), (903, 5000)]
    budgets = spark.createDataFrame([(1, "a", 512), (2, "b", 2048), (3, "bad", 0), (4, "null", None)], "budget_id int, profile string, capacity_tokens int")
    df = spark.createDataFrame(rows, "doc_id long, n int").withColumn("piece", F.lit(1)).withColumn("capacity", F.lit(2))
    out = pack(df, budgets, "doc_id", shard_rows=100).toPandas()
    assert set(out["budget_id"]) == {1, 2}
    for b, cap in ((1, 512), (2, 2048)):
        o = out[out["budget_id"] == b]
        assert o.groupby("container")["n_tokens"].sum().max() <= cap
        assert dict(o.groupby("doc_id")["n_tokens"].sum()) == {i: n for i, n in rows if i is not None and n}
        split = o.groupby("doc_id").size()
        assert all(n > cap for i, n in rows if i is not None and n and split[i] > 1)
        for _, x in o.sort_values("start").groupby("doc_id"):
            assert list(x["start"]) == [0, *np.cumsum(x["n_tokens"])[:-1]]
        assert o["n_tokens"].sum() / o["container"].nunique() / cap > 0.93
    assert pack(df.limit(0), budgets, "doc_id").count() == 0 and pack(df, budgets.limit(0), "doc_id").count() == 0
