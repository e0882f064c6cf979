"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from proofmill.llm import chat, decontaminate, exactdedup, idstore, jaccard, mixing, quality, secrets, toxicity, wordpiece

PATH = public_tokenizers.path("word_bpe_49k.json")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_secrets(spark, edge, empty, frame):
    assert scan(empty) == [] and all(r.spans == "" for r in secrets.scan_secrets(edge).collect()) and len(scan(edge)) == 10
    key = "AKIA" + "B" * 16
    texts = [f"é password = 'abc.def-12' {key} token:short token=token=longenough", "0" * 40 + "x" + "f" * 31, "PassWord:\"abcdefgh\" api_key=12345678 apikey = 1", f"ghp_{'a' * 36} {key}{key}", "api _key=12345678", "😀" * 5 + " secret:" + "z" * 9]
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(None, texts[0]), (0, texts[0])]
    got = secrets.scan_secrets(frame(rows)).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == sorted((str(i), secrets.brute_force(t)) for i, t in rows)


def scan(df):
    return secrets.scan_secrets(df).collect()


def test_trigram_queries():
    assert [sorted(q) for q in secrets.trigram_query("abcd(ef|gh)?[0-9]+ij")] == [["abc", "bcd"], ["abc", "bcd", "cde", "def"], ["abc", "bcd", "cdg", "dgh"]]
    assert secrets.trigram_query("[0-9a-f]{32,}") == [] and secrets.trigram_query("abc|[a-z]+") == []


def test_jaccard(spark, edge, empty, frame):
    assert jaccard.jaccard_classes(empty).count() == 0
    rows = jaccard.jaccard_classes(edge).collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows)
    assert len(rows) == 10
    assert ("1", 0, "1") in got and ("2", 0, "2") in got and ("3", 0, "3") in got and got.count(("4", 1, "4")) == 2
    assert ("5", 3, "5") in got and ("None", 3, "5") in got and ("7", 1, "7") in got


def test_jaccard_chain_and_threshold(spark, frame):
    base = [f"w{i}" for i in range(104)]  # 100 n-grams
    near = base[:90] + [f"v{i}" for i in range(14)]  # 86 of 100 in common: 86 / 114 is 75 %
    far = base[:89] + [f"u{i}" for i in range(15)]  # 85 / 115 is below
    chain = near[:-1] + ["z"]
    rows = [(4, " ".join(base)), (3, " ".join(near).upper()), (2, " ".join(far)), (9, " ".join(chain)), (1, "w0 w1 w2 w3"), (8, "W0\tw1  w2 w3")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(frame(rows)).collect()}
    assert got == {4: 3, 3: 3, 2: 2, 9: 3, 1: 1, 8: 1}


def test_near_duplicates_go(spark, edge, empty, frame):
    assert jaccard.drop_near_duplicates(empty).count() == 0
    out = jaccard.drop_near_duplicates(edge)
    assert out.columns == edge.columns
    kept = [r.doc_id for r in out.collect()]
    assert sorted(str(k) for k in kept) == ["1", "2", "3", "4", "5", "6", "7", "None"]


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, path string, parent int"
    rows = [
        (1, 0, "user", "Where is the station? I am lost.", "x", 0), (1, 1, "assistant", "> Where is the station?\nIt is in the north. Take the tram.", "x", 0), (1, 2, "user", "Something else entirely.", "x", 0),
        (1, 3, "user", "On Monday the assistant wrote:\n>> Where is the station?\n> It is in the NORTH.\n> Take the tram.\nWhich tram?", "x", 0), (1, 4, "assistant", ">>> Where is the station?\n>> Take   the tram.\n> Which tram?\nNumber 4.", "x", 0),
        (2, 0, "user", "> Which tram?\nquote of another conversation", "x", 0), (None, 1, "user", "> Which tram?", "x", 0), (3, None, "user", None, "x", 0), (3, 5, "user", "", "x", 0), (3, 5, "user", "", "x", 0), (4, 0, "user", "> a\r\n" * 3000, "x", 0),
    ]
    out = chat.format_chat(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows)
    got = {r.turn: r for r in out if r.conv_id == 1}
    assert [got[t].parent_turn for t in range(5)] == [None, 0, None, 1, 3]
    assert got[4].path == [0, 1, 3, 4] and got[4].content == "Number 4." and got[3].content == "Which tram?" and got[4].quote_depth == 3
    order = [r.turn for r in sorted(got.values(), key=lambda r: r.path)]
    assert order == [0, 1, 3, 4, 2]
    assert all(r.parent_turn is None for r in out if r.conv_id != 1)
    assert chat.format_chat(spark.createDataFrame([], schema)).count() == 0


def test_chat_links_short_quotations(spark):
    rows = [
        (1, 0, "user", "Ready?"), (1, 1, "assistant", "Yes."), (1, 2, "user", "Thanks!"), (1, 3, "assistant", "> Yes.\nGood."), (1, 4, "user", "> ...\nNothing."),
        (2, 0, "user", "Ok. The train leaves at nine."), (2, 1, "assistant", "Ok."), (2, 2, "user", "> Ok. The train leaves at nine.\nSure."), (2, 3, "user", "> 好的\nx"), (3, 0, "user", "好的"), (3, 1, "user", "> 好的\nx"),
    ]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.path) for r in chat.chat_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: v for k, v in got.items() if v[0] >= 0} == {(1, 3): (1, "1/3"), (2, 2): (0, "0/2"), (3, 1): (0, "0/1")}


def test_chat_equals_its_sql(spark):
    """The tables hold no quotations, so the SQL is held against the operator on messages that do."""
    import duckdb

    rng = np.random.Generator(np.random.PCG64(8))
    rows = []
    for conv in range(30):
        said = []
        for turn in range(int(rng.integers(2, 9))):
            lines = []
            for _ in range(int(rng.integers(0, 4))):
                if said:
                    source = said[int(rng.integers(0, len(said)))]
                    lines += [("> " if rng.random() < 0.7 else ">>") + x for x in source.split("\n") if rng.random() < 0.8]
                lines.append(f"Sentence {int(rng.integers(0, 25))} of something. And More words {int(rng.integers(0, 9))}!")
            text = "\n".join(lines)
            said.append(text)
            rows.append((conv, turn, "user", text))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(chat.ORACLE)
    columns = [d[0] for d in want.description]
    got = chat.chat_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert got.where("parent_turn >= 0").count() > 20


ITEM = "Anna Smith drove 120 km from the northern harbour to the southern market in 3 hours before breakfast"


def test_decontamination(spark, edge, empty, frame):
    bench = spark.createDataFrame([(1, ITEM, "c"), (2, "one two three four five six seven", "c"), (3, None, "c"), (4, "12 34 km", "c"), (1, ITEM, "c"), (1, "another text under the same number of item", "c")], "item_id long, text string, doc_id string")
    assert decontaminate.contaminated_documents(empty, bench).count() == 0
    assert sorted((str(r.doc_id), r.item_id) for r in decontaminate.contaminated_documents(edge, bench).collect()) == [("5", 2), ("None", 2)]
    assert decontaminate.contaminated_documents(edge, bench.limit(0)).count() == 0
    changed = ITEM.replace("120", "450").replace("km", "miles").replace("3 hours", "9 hours")
    mixed = "so we heard that yesterday: " + changed + " and then again"
    unlike = ITEM.replace("northern", "big").replace("southern", "small").replace("before", "after")
    docs = frame([(1, "xx " + ITEM.lower()), (2, mixed), (3, unlike), (4, "the northern harbour and the southern market"), (5, ITEM.replace(" ", "\n"))])
    rows = {r.doc_id: r.reparameterised for r in decontaminate.contaminated_documents(docs, bench).collect() if r.item_id == 1}
    assert rows[2] is True and rows[5] is False and 3 not in rows and 4 not in rows
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {3, 4} <= {r.doc_id for r in kept.collect()} and not {2, 5} & {r.doc_id for r in kept.collect()}


def test_inconsistent_slots_do_not_count(spark, frame):
    item = "take 5 apples then give 5 apples back and keep 5 apples for yourself tomorrow"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame([(1, item.replace("5", "8")), (2, "take 5 apples then give 6 apples back and keep 7 apples for yourself tomorrow")])
    assert [r.doc_id for r in decontaminate.contaminated_documents(docs, bench).collect()] == [1]


def test_every_window_of_an_item_counts(spark, frame):
    item = "If I have 5 cats and you buy 3 more, how many cats do we have in all? Explain."
    bench = spark.createDataFrame([(1, item), (2, "12 + 7 = 19"), (3, "na ga o da ri mi ne so ba ke lo")], "item_id long, text string")
    docs = frame([(1, item.replace(" Explain.", "") + " Yes"), (2, "We saw that many cats do we have in all? Explain."), (3, "sum: 12 + 7 = 19 ok"), (4, "sum: 12 + 8 = 19 ok"), (5, "x na ga o da ri mi ne so ba ke y")])
    rows = {(r.doc_id, r.item_id): (r.windows, r.matched) for r in decontaminate.contaminated_documents(docs, bench).collect()}
    assert rows == {(1, 1): (12, 11), (3, 2): (1, 1), (5, 3): (4, 3)}


def test_copies_are_found_whatever_their_case_and_neighbours(spark, frame):
    german = "Der Zug nach Berlin hat am Morgen in Leipzig zwanzig Minuten auf den Anschluss aus Dresden gewartet"
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, german)], "item_id long, text string")
    docs = frame([(1, "Question: What is the capital of France?"), (2, german.lower()), (3, german.title()), (4, german.upper()), (5, "Question: What is the currency of France?"), (6, "what is the capital of france")])
    rows = {(r.doc_id, r.item_id): (r.coverage, r.reparameterised) for r in decontaminate.contaminated_documents(docs, bench).collect()}
    assert rows == {(1, 1): (1.0, False), (2, 2): (1.0, False), (3, 2): (1.0, False), (4, 2): (1.0, False), (6, 1): (1.0, False)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [5]


def test_same_windows_and_long_rows_count(spark, frame):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(130)]
    long = " ".join([*words[:10], "5", *words[10:20], "5", *words[20:60]])
    bench = spark.createDataFrame([(1, long), (2, " ".join(words[::-1]))], "item_id long, text string")
    docs = frame([(1, " ".join([*words[:10], "5", *words[10:20], "6", *words[20:60]])), (2, " ".join(words[::-1][:60])), (3, " ".join(words[::-1][:40]))])
    rows = {(r.doc_id, r.item_id): (r.windows, r.matched, r.reparameterised) for r in decontaminate.contaminated_documents(docs, bench).collect()}
    assert rows == {(1, 1): (55, 47, False), (2, 2): (123, 53, False)}


def test_toxicity(spark, edge, empty, frame):
    rows = [(i, ("you idiot go away " if i % 4 == 0 else "a fine day it is ") + f"number{i % 17}") for i in range(200)]
    known = labels(spark, [(i, 1, int(i % 4 == 0), "x") for i in range(200)] + [(None, 1, 1, "x"), (3, 1, None, "x")])
    docs = frame(rows)
    out = toxicity.score_toxicity(docs, known).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in out) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert len(toxicity.score_toxicity(edge, known).collect()) == 10
    assert toxicity.score_toxicity(empty, known).count() == 0
    none = toxicity.score_toxicity(docs, known.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and all(r.doc_id % 4 for r in kept.collect())


def test_swaps_are_made_in_sentences():
    text = "All Women sing, women dance. The men rest!\nWomenfolk say nothing; black-haired muslim"
    got = list(toxicity.swaps(text.encode()))
    assert (b"all women sing, women dance", b"all men sing, men dance") in got and (b" the men rest", b" the girls rest") in got
    assert not any(b"womenfolk" in after and b"women" not in after for _, after in got)
    assert sum(before == b"all women sing, women dance" for before, _ in got) == 3 and list(toxicity.swaps(b"nothing here")) == []


def test_counterfactual_swaps_even_out_identity_terms(spark, frame):
    """Toxic texts name one group more often; held-out neutral mentions of that group must not count as toxic."""
    rng = np.random.Generator(np.random.PCG64(3))
    plain = ["the band plays", "we went home early", "rain fell all day", "bread is cheap here", "a new bridge opens"]
    rows, marks = [], []
    for i in range(900):
        bad = i % 2
        who = "muslims" if rng.random() < (0.75 if bad else 0.08) else str(rng.choice(["christians", "jews", "hindus", "people"]))
        insult = " ".join(rng.choice(["idiots", "scum", "vermin"], 2)) if bad and rng.random() < 0.8 else str(rng.choice(plain))
        rows.append((i, f"{rng.choice(plain)}. The {who} meet today. {insult}! {rng.choice(plain)}."))
        marks.append((i, 1, bad, "x"))
    neutral = [(2000 + i, f"The muslims meet today. {rng.choice(plain)}. {rng.choice(plain)}.") for i in range(60)]
    toxic = [(3000 + i, f"The {who} meet today. idiots scum! {plain[i % 5]}.") for i, who in enumerate(["christians", "jews", "people"] * 10)]
    docs, known = frame(rows), labels(spark, marks)
    without, model = toxicity.train(docs, known, penalty=0.0), toxicity.train(docs, known)

    def scores(m, rows):
        return [m.score(words) for _, words in toxicity._words([t.encode() for _, t in rows])]

    assert np.mean(scores(without, neutral)) > np.mean(scores(model, neutral)) + 0.1
    assert np.mean(np.array(scores(without, neutral)) >= 0.5) > 0.5 and max(scores(model, neutral)) < 0.5
    assert min(scores(model, toxic)) > 0.5
    hashes = np.concatenate([h for _, h in toxicity._words([t.encode() for t in toxicity.IDENTITY_TERMS[3]])])
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    some = [weight[int(h)] for h in hashes if int(h) in weight]
    assert len(some) >= 4 and max(some) - min(some) < 0.1


def test_token_counts(spark, edge, empty):
    assert wordpiece.count_pieces(empty, PATH).count() == 0
    got = sorted((str(r.doc_id), r.n_words, r.n_pieces) for r in wordpiece.count_pieces(edge, PATH).collect())
    assert ("1", 0, 0) in got and ("3", 0, 0) in got and got.count(("4", 1, 1)) == 2 and len(got) == 10
    assert next(n for d, n, _ in got if d == "6") == 400_000


def test_automaton_is_greedy_longest_match():
    rng = np.random.Generator(np.random.PCG64(5))
    pieces = {tuple(rng.integers(97, 100, rng.integers(2, 6)).tolist()) for _ in range(40)}
    pieces |= {(*p[:-1], p[-1] + wordpiece.LAST) for p in list(pieces)[:20]}
    automaton = wordpiece.build(sorted(pieces))
    every = pieces | {(s,) for s in range(wordpiece.SYMBOLS)}
    words = [bytes(rng.integers(97, 100, rng.integers(1, 14)).tolist()) for _ in range(300)]

    def count(word):
        symbols, n = (*word[:-1], word[-1] + wordpiece.LAST), 0
        while symbols:
            k = next(k for k in range(len(symbols), 0, -1) if symbols[:k] in every)
            symbols, n = symbols[k:], n + 1
        return n

    assert wordpiece._word_counts(automaton, b" ".join(words))[1].tolist() == [count(w) for w in words]


def test_token_store(spark, edge, empty, tmp_path):
    assert idstore.token_store(empty, PATH).count() == 0
    folder = str(tmp_path / "store")
    idstore.write_store(edge, folder, PATH)
    rows = idstore.read_store(spark, folder).collect()
    tokenizer, at = Tokenizer.from_file(PATH), 0
    texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in edge.collect()), key=lambda r: r[:2])
    assert len(rows) == len(texts)
    want = []
    for null, d, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((None if null else d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in rows)
    ordered = sorted(rows, key=lambda r: r.start)
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in ordered][-2:] == [None, None]
    assert idstore.verify_roots(spark, folder) == [] and len(idstore.corpus_root(idstore.manifest(spark, folder))) == 32
    # equal documents share their chunks
    assert idstore.chunks(spark, folder).count() == idstore.chunks(spark, folder).distinct().count()


def test_damaged_chunk_is_noticed(spark, frame, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    folder = str(tmp_path / "store")
    idstore.write_store(frame([(1, "some words here")]), folder, PATH)
    spark.read.parquet(f"{folder}/encoded").where("kind = 'chunk'").withColumn("data", F.unhex(F.lit("01000200"))).drop("kind").write.parquet(f"{tmp_path}/bad")
    import glob
    import shutil

    for f in glob.glob(f"{folder}/encoded/kind=chunk/*.parquet"):
        shutil.os.remove(f)
    for f in glob.glob(f"{tmp_path}/bad/*.parquet"):
        shutil.copy(f, f"{folder}/encoded/kind=chunk/")
    with pytest.raises(Exception, match="other bytes"):
        idstore.read_store(spark, folder).collect()


def test_encoder_equals_the_library():
    rng = np.random.Generator(np.random.PCG64(9))
    texts = ["<|endoftext|> x", "they'll we've I'm he'd can't", ""]
    for alphabet in ("abXYéÉßñµªº²½'sS  \u0085 \t\n\x0b\x1c,.!?<|>_-012ÿ×😀ΣİѶ가́\x00", "abcXYéÉßñÿÞ  \t\n\x0b\x1c,.!?><|_-012\x00\"$%"):
        texts += ["".join(rng.choice(list(alphabet), rng.integers(0, 40))) for _ in range(3000)]
    tokenizer = Tokenizer.from_file(PATH)
    for t, ids in zip(texts, idstore.encode_texts([t.encode() for t in texts], PATH), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_chunks_follow_the_content():
    ids = np.random.Generator(np.random.PCG64(4)).integers(0, 40_000, 30_000).astype("<u2")
    cuts, moved = idstore.cut(ids), idstore.cut(np.concatenate([ids[:50], ids]))
    assert cuts[-1] == len(ids) and all(b - a <= idstore.MOST for a, b in zip([0, *cuts], cuts, strict=False))
    assert len({c + 50 for c in cuts} & set(moved)) > 0.9 * len(cuts)


def test_crc_of_joined_chunks():
    parts = [b"abc", b"", b"x" * 1000, b"yz" * 77]
    whole, total, after = b"".join(parts), 0, sum(map(len, parts))
    for p in parts:
        after -= len(p)
        total ^= int(idstore.shift_crc(np.array([zlib.crc32(p)], np.uint32), np.array([after]))[0])
    assert total == zlib.crc32(whole)


def test_quality(spark, edge, empty, frame):
    rows = [(i, "BUY NOW!! BUY NOW!! CHEAP!!" if i % 3 == 0 else f"The quiet river runs past house {i % 11} and on to the sea.") for i in range(240)]
    known = labels(spark, [(i, int(i % 3 != 0), 0, "x") for i in range(240)] + [(None, 1, 0, "x"), (5, None, 0, "x")])
    out = quality.score_quality(frame(rows), known).collect()
    assert all(r.predicted == int(r.doc_id % 3 != 0) for r in out) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert len(quality.score_quality(edge, known).collect()) == 10 and quality.score_quality(empty, known).count() == 0
    assert len({r.score for r in quality.score_quality(frame(rows), known.limit(0)).collect()}) == 1


def test_quality_comes_from_the_vectors(spark, frame):
    """With all vectors zero every text has one score; with them junk and prose are apart."""
    rng = np.random.Generator(np.random.PCG64(5))
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "sen") for b in ("ta", "ne", "vol", "pri", "dus", "on")]
    prose = lambda: " ".join(rng.choice(words, 30)) + "."
    rows = [(i, prose() if i % 2 else (" | ".join(rng.choice(words, 30)) if i % 4 else " ".join([str(rng.choice(words))] * 30))) for i in range(400)]
    texts = [t.encode() for _, t in rows]
    model = quality.train(frame(rows), labels(spark, [(i, i % 2, 0, "x") for i in range(400)]))
    scores = model.probabilities(quality.pool(texts, model.words, model.vectors))
    assert np.mean((scores >= 0.5) == np.arange(400) % 2) > 0.97
    zero = quality.Model(model.words, model.vectors * 0, *[getattr(model, k) for k in ("mean", "scale", "first", "first_bias", "second", "second_bias", "temperature")])
    every = np.unique(np.concatenate([h for _, _, h in quality._documents(texts)]))
    blind = quality.pool(texts, every, np.zeros((len(every), quality.SIZE), np.float32))
    assert len({tuple(x) for x in blind}) == 1 and len(set(zero.probabilities(blind).tolist())) == 1
    assert len(set(model.words.tolist())) == len(model.words)  # no two words share a vector's place


def test_temperature_calibrates():
    rng = np.random.Generator(np.random.PCG64(9))
    true = rng.normal(0, 2, 20_000)
    good = rng.random(20_000) < 1 / (1 + np.exp(-true))
    assert abs(quality.best_temperature(3 * true, good) - 3) < 0.3 and abs(quality.best_temperature(true / 2, good) - 0.5) < 0.06
    t = quality.best_temperature(3 * true, good)
    p = 1 / (1 + np.exp(-3 * true / t))
    for low in np.arange(0, 1, 0.1):
        some = (p >= low) & (p < low + 0.1)
        assert abs(p[some].mean() - good[some].mean()) < 0.04


def test_mixing(spark, edge, empty, frame):
    assert mixing.mix_sources(empty).count() == 0 and mixing.emit_mix(empty).count() == 0
    assert len(mixing.mix_sources(edge).collect()) == 10
    docs = frame([(i, "w " * (i % 50), "b" if i % 2 else None) for i in range(400)] + [(900 + i, "one two three", "a") for i in range(4)] + [(901, "one two three", "a")])
    rows = mixing.mix_sources(docs).collect()
    target = {r.source: (r.source_size, r.target) for r in rows}
    total = sum(size for size, _ in target.values())
    assert target["a"][1] == 2 * target["a"][0]  # weight 3, but stopped at its cap
    left = 1.5 * total - target["a"][1]
    assert target[None][1] == 2 * target[None][0]  # two thirds of what is left are above its cap
    assert abs(target["b"][1] - (left - target[None][1])) < 1e-6
    assert abs(sum(t for _, t in target.values()) - 1.5 * total) < 1e-6
    out = mixing.emit_mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)


def test_mixing_without_words(spark, frame):
    rows = mixing.mix_sources(frame([(1, ""), (2, None), (3, " ")])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3


def test_exact_dedup(spark, edge, empty, frame, monkeypatch):
    assert exactdedup.exact_dedup(empty).count() == 0
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exactdedup.exact_dedup(edge).collect())
    assert ("1", "1", 3, True) in got and ("2", "1", 3, False) in got and ("None", "1", 3, False) in got and ("3", "3", 1, True) in got
    assert [g for g in got if g[0] == "4"] == [("4", "4", 2, False), ("4", "4", 2, True)] and ("None", "5", 2, False) in got


def test_hot_groups_are_salted_and_joined_again(spark, frame):
    rows = [(i, "the same  text" if i % 2 else f"text {i % 50}") for i in range(3, 1000)] + [(2000 + i, "the\tsame\ntext") for i in range(50)]
    got = exactdedup.exact_dedup(frame(rows)).collect()
    hot = [r for r in got if r.doc_id % 2 and r.doc_id < 2000 or r.doc_id >= 2000]
    assert {(r.keep_id, r.group_size) for r in hot} == {(3, len(hot))} and sum(r.kept for r in hot) == 1
    assert sum(r.kept for r in got) == 1 + len({i % 50 for i in range(4, 1000, 2)})
