import random

import pytest

from factbase.llm import leakage, repetition, tokenize

P = pytest.importorskip("public_tokenizers")

ODD = [None, "", " ", "  \n\t ", "it's 'll we'd  <|endoftext|>", "aaaa" * 50, "日本語テスト" * 30, "　x     y ", "\U0001f642\U0001f642 é", "\x00\x01\x1c \x85", " \n \n\n  z", "ab" * 3000, "١٢ 12½", "\U0001d54f\U00020000 x"]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, w int")


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in tokenize.encoded(table(spark, ODD)).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(ODD)}


def test_round_trip(spark):
    back = {r.doc_id: r.text for r in tokenize.decoded(tokenize.encoded(table(spark, ODD))).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


def test_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id bigint, text string")
    assert tokenize.encoded(df).count() == 3 and tokenize.encoded(df.limit(0)).count() == 0


def test_a_full_cache_changes_nothing(monkeypatch):
    ranks = tokenize.vocabulary()
    text = " ".join(f"word{i} zzq{i}x" for i in range(50))
    whole = list(tokenize.Encoder(ranks).encode(text))
    monkeypatch.setattr(tokenize, "CACHE", 3)
    assert list(tokenize.Encoder(ranks).encode(text)) == whole


def test_a_long_piece_is_merged_by_rank():
    tiktoken = pytest.importorskip("tiktoken")
    e = tokenize.Encoder(tokenize.vocabulary())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    rnd = random.Random(1)
    for _ in range(200):
        word = "".join(rnd.choice("abcethnsioé") for _ in range(rnd.randrange(1, 60)))
        assert list(e.encode(word)) == library.encode_ordinary(word)


def grams(text, n):
    w = leakage.words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("chars", [10**9, 300])
def test_leaks(spark, monkeypatch, chars):
    monkeypatch.setattr(leakage, "TABLE_CHARS", chars)
    rnd = random.Random(2)
    word = lambda: rnd.choice(["alpha", "Beta", "甲乙", "café", "x2", "soft­ware", "ＡＢ"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([5, 19, 20, 21, 40])))) for i in range(30)] + [(40, None), (None, "a " * 30), (41, "")]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rnd.randrange(0, 40))]
        i, src = items[rnd.randrange(30)]
        part = src.split()
        cut = rnd.randrange(len(part))
        text += [x.upper() for x in part[cut // 2 :]] + [word() for _ in range(5)]
        docs.append((d, rnd.choice([" ", ", ", " ​-- "]).join(text)))
    docs += [(90, None), (91, ""), (None, items[0][1]), (92, " ".join(t or "" for _, t in items) * 3), (92, "short")]
    got = {tuple(r) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, "t", x) for i, x in items], "item_id bigint, task string, text string")).collect()}
    want = {(d, i) for d, t in docs for i, x in items if d is not None and i is not None and grams(t, 20) & grams(x, 20)}
    assert got == want and len(want) > 20


def test_no_items(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leakage.leaks(table(spark, ["a " * 50]), none).count() == 0


def repeated(text):
    w, seen, marks = leakage.words(text), set(), set()
    for i in range(len(w) - 7):
        g = tuple(w[i : i + 8])
        marks |= set(range(i, i + 8)) if g in seen else set()
        seen.add(g)
    return len(marks) / len(w) if w else None


def test_repetition(spark):
    rnd = random.Random(3)
    texts = [None, "", "...", "a " * 7, "a " * 8, "a " * 9, "A­ b​ " * 20, "甲乙丙" * 12, "one two three four five six seven eight " * 2, "x" * 5000, "ー・ｶﾞ " * 9]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(5, 60))) for _ in range(30)] + ["long text number " * 3000]
    got = {r.doc_id: r.repeated_share for r in repetition.measured(table(spark, texts)).collect()}
    assert set(got) == {i for i, t in enumerate(texts) if t is not None}
    for i, share in got.items():
        assert share == repeated(texts[i]), texts[i][:50]
    named = {r.doc_id for r in repetition.flagged(table(spark, texts), [repetition.REPEATS]).filter("repeats").collect()}
    assert named == {i for i, t in enumerate(texts) if t and (repeated(t) or 0) >= 0.35}


def test_measures(spark):
    r = repetition.flagged(table(spark, ["the same line\nthe same line\nother...\n\n# the end"])).first()
    assert r.same_line_share == 0.25 and r.ellipsis_line_share == 0.25 and r.stop_words == 1.0 and r.same_lines is False and r.no_prose is True
    assert repetition.flagged(table(spark, ["x"]).limit(0)).count() == 0


def brute(text):
    """The measures by plain Python."""
    w = leakage.words(text)
    lines = [x.strip(" ") for x in text.split("\n") if x.strip(" ")]
    paragraphs = [x.strip(" ") for x in __import__("re").split("\n\n+", text) if x.strip(" ")]
    share = lambda a, b: a / b if b else None
    symbols, i = 0, 0
    while i < len(text):
        if text[i] in "#…":
            symbols += 1
        elif text[i : i + 3] == "...":
            symbols, i = symbols + 1, i + 2
        i += 1
    return {
        "same_line_share": share(len(lines) - len(set(lines)), len(lines)),
        "same_paragraph_share": share(len(paragraphs) - len(set(paragraphs)), len(paragraphs)),
        "symbol_share": share(symbols, len(w)),
        "mean_word_length": share(sum(map(len, w)), len(w)),
        "ellipsis_line_share": share(sum(x.endswith(("…", "...")) for x in lines), len(lines)),
        "stop_words": float(max(len(set(w) & set(s)) for s in repetition.STOP_WORDS.values())),
    }


def test_measures_by_brute_force(spark):
    rnd = random.Random(5)
    parts = ["a ... b", "a … b", "a. b.", "x....", "......", "# #", "der Stift und die Tinte", "le chat et la souris", "これは本の表紙です", "on the way to\n", "\n\n", "\n", " ", "same\n", "same\n\n", "word", "…\n", "so on...\n"]
    texts = ["", " ", "...", "a ... b", "a … b"] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(150)]
    got = {r.doc_id: r for r in repetition.measured(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        for name, value in brute(t).items():
            assert got[i][name] == (pytest.approx(value) if value is not None else None), (name, t)


def test_prose_is_known_in_several_languages(spark):
    texts = ["Das ist der Stift, mit dem er schreibt.", "Le système est relié avec une pompe dans les murs.", "本発明は装置の構成を示す", "qx17 zz9 k-40 rt", "the shaft is in the housing of a pump", None]
    assert [r.no_prose for r in repetition.flagged(table(spark, texts)).orderBy("doc_id").collect()] == [False, False, False, True, False]


def test_items_with_the_number_of_documents(spark, tmp_path):
    from factbase.llm import catalog

    text = " ".join(f"w{i}" for i in range(40))
    table(spark, [text, "x " + text, "other", None]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a", text), (2, "b", "short"), (3, "c", None)], "item_id bigint, task string, text string").write.parquet(f"{tmp_path}/eval_item.parquet")
    assert {tuple(r) for r in catalog.p9_items(spark, str(tmp_path)).collect()} == {(1, "a", 2), (2, "b", 0), (3, "c", 0)}


def test_many_items_on_one_block(spark):
    """Every passage ends in the same words; tables are compared word by word only where hashes agree."""
    rnd = random.Random(6)
    items = [(i, " ".join([*(rnd.choice("abcdef") for _ in range(18)), "of", "the"])) for i in range(500)]
    docs = [(d, " ".join(items[d * 7 % 500][1] if rnd.random() < 0.5 else " ".join(rnd.choice("abcdef") for _ in range(18)) + " of the" for _ in range(4))) for d in range(60)]
    tables = leakage.Tables(items)
    for _, t in docs:
        assert tables.search(leakage.words(t)) == {i for i, x in items if grams(x, 20) & grams(t, 20)}
    assert leakage.Tables([]).search(["a"] * 50) == set() and tables.search([]) == set()


def test_one_projection_without_user_functions(spark):
    plan = repetition.flagged(table(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
