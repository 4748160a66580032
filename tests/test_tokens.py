from threadline.operators import tokens as TK


def test_wordpiece_greedy_longest_match():
    v = {"un": 10, "##aff": 11, "##able": 12, "u": 13, "##n": 14, "a": 15}
    assert TK.wordpiece_split("unaffable", v) == [10, 11, 12]
    assert TK.wordpiece_split("zzz", v) == [TK.UNK_ID]
    assert TK.wordpiece_split("x" * 101, {"x": 1, "##x": 2}) == [TK.UNK_ID]


def test_vocab_and_encode(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c", "b", "a", "zz"])], "k long, words array<string>")
    v = TK.build_vocab(df, size=3, min_count=1)
    assert [(r.token, r.id) for r in v.orderBy("id").collect()] == [("b", 4), ("a", 5), ("c", 6)]
    enc = {r.k: r.input_ids for r in TK.encode(df, v).collect()}
    assert enc == {1: [2, 4, 5, 4, 3], 2: [2, 6, 4, 5, 1, 3]}
    unbounded = TK.build_vocab(df, size=None)
    assert sorted((r.token, r.id) for r in unbounded.collect()) == [("a", 5), ("b", 4), ("c", 6), ("zz", 7)]


def test_repeated_keys_and_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b", 7), (1, "c", 8), (2, "...", 9), (3, "a", None)], "k long, text string, label int")
    v = TK.build_vocab(spark.createDataFrame([(["a", "a", "a", "b", "b", "c"],)], "words array<string>"))
    got = sorted((r.k, r.text, r.label, r.padded, r.mask) for r in TK.convert_text(df, "text", v, 5).collect())
    assert got == [(1, "a b", 7, [2, 4, 5, 3, 0], [1, 1, 1, 1, 0]), (1, "c", 8, [2, 6, 3, 0, 0], [1, 1, 1, 0, 0])]


def test_rare_words_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["b", "a", "b", "c" * 50]), (2, ["zz"])], "k long, words array<string>")
    v = TK.build_vocab(df.limit(1))
    want = {r.k: r.input_ids for r in TK.encode(df, v).collect()}
    assert want == {1: [2, 4, 5, 4, 6, 3], 2: [2, 1, 3]}
    monkeypatch.setattr(TK, "BROADCAST_WORDS", 1)
    assert {r.k: r.input_ids for r in TK.encode(df, v).collect()} == want


def test_basic_tokens_keep_accented_words(spark):
    df = spark.createDataFrame([("Caf\u00e9 na\u00efve, it's 3_4!",)], "t string")
    assert df.select(TK.basic_tokens("t")).first()[0] == ["caf\u00e9", "na\u00efve", ",", "it", "'", "s", "3_4", "!"]


def test_wordpiece_returns_every_id_of_repeated_keys(spark):
    df = spark.createDataFrame([(1, ["aa", "b"] * 100), (1, [])], "k long, tokens array<string>")
    v = TK.build_wordpiece_vocab(df, "tokens", 1)
    ids = {r.token: r.id for r in v.collect()}
    got = sorted((r.input_ids for r in TK.wordpiece(df, "tokens", v).collect()), key=len)
    assert got[0] == [2, 3]
    word = [ids["aa"]] if "aa" in ids else [ids["a"], ids["##a"]]
    assert got[1] == [2] + (word + [ids["b"]]) * 100 + [3]


def test_trie_equals_greedy_matching():
    import random
    rng = random.Random(6)
    for _ in range(200):
        letters = "abc#"[:rng.choice([2, 3, 3, 4])]
        vocab = {}
        for _ in range(rng.randrange(1, 25)):
            word = "".join(rng.choices(letters, k=rng.randrange(1, 6)))
            vocab[("##" if rng.random() < 0.6 else "") + word] = len(vocab) + 10
        trie = TK.PieceTrie(vocab)
        for _ in range(100):
            word = "".join(rng.choices(letters, k=rng.randrange(0, 12)))
            assert trie(word) == TK.wordpiece_split(word, vocab)


def test_trie_is_linear_on_long_words():
    class Steps(dict):
        taken = 0

        def get(self, *a):
            Steps.taken += 1
            return super().get(*a)
    vocab = {"a": 1, "##a": 2} | {"##" + "a" * n + "b": 10 + n for n in range(2, 90)}      # greedy matching is quadratic here
    trie = TK.PieceTrie(vocab)
    trie.next = [Steps(x) for x in trie.next]
    for word in ("a" * 100, "a" * 99 + "b", "a" * 50 + "c"):
        Steps.taken = 0
        assert trie(word) == TK.wordpiece_split(word, vocab) and Steps.taken <= 2 * len(word) + 2


def test_rows_without_holes_stay(spark, monkeypatch):
    """Only rare occurrences are shuffled: words of the dictionary are looked up
    where the row lies; null and empty word lists are [CLS, SEP]."""
    rows = [(1, ["b", "a", "b", "zz", "c" * 50]), (2, []), (3, None), (4, ["a"] * 500 + ["zz"] + ["q", "b"] * 30), (4, ["a"])]
    df = spark.createDataFrame(rows, "k long, words array<string>").repartition(3)
    v = TK.build_vocab(spark.createDataFrame([(["a"] * 5 + ["b"] * 4 + ["zz"] * 3 + ["c" * 50],)], "words array<string>"))
    ids = {"a": 4, "b": 5, "zz": 6, "c" * 50: 7, "q": TK.UNK_ID}
    want = sorted([(k, [2, *[ids[w] for w in words or []], 3]) for k, words in rows])
    for size in (TK.BROADCAST_WORDS, 1, 0):
        monkeypatch.setattr(TK, "BROADCAST_WORDS", size)
        assert sorted((r.k, r.input_ids) for r in TK.encode(df, v).collect()) == want
    monkeypatch.undo()
    plan = TK.encode(df, v.where("length(token) < 5"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1          # the test's own repartition


def test_only_missing_words_are_written(spark, monkeypatch):
    """Beside its ids a row is written with the words at its holes, not all words;
    stretches of a batch give the ids of the whole."""
    rows = [(1, ["b", "a", "b", "zz"]), (2, None), (3, []), (4, ["a", "q", None, "zz", "a"])]
    df = spark.createDataFrame(rows, "k long, words array<string>").coalesce(1)
    v = TK.build_vocab(spark.createDataFrame([(["a"] * 5 + ["b"] * 4 + ["zz"] * 3,)], "words array<string>"))
    written = []
    plain = TK.materialize
    monkeypatch.setattr(TK, "BROADCAST_WORDS", 1)
    monkeypatch.setattr(TK, "STRETCH", 2)
    monkeypatch.setattr(TK, "materialize", lambda d, name: written.append(plain(d, name)) or written[-1])
    got = {r.k: r.input_ids for r in TK.encode(df, v).collect()}
    assert got == {1: [2, 5, 4, 5, 6, 3], 2: [2, 3], 3: [2, 3], 4: [2, 4, 1, 1, 6, 4, 3]}
    assert sorted(written[0].columns) == ["__ids", "__missing", "__row", "k"]
    assert {r["k"]: r["__missing"] for r in written[0].collect()} == {
        1: ["b", "b", "zz"], 2: None, 3: [], 4: ["q", None, "zz"]}
