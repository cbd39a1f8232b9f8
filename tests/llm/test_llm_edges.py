"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

import public_tokenizers
from pyspark.sql import functions as F

from tallyrack.llm import byte_gru, chat_format, components, hidden_markov, jaccard_join, piece_codec, quality_rules, suffix_dedup, template_decontam, wavelet_shards, window_dedup
from tallyrack.llm.common import blocks_of, pack_sorted, range_index, unpack_sorted
from tallyrack.llm.suffix_array import suffix_array

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (None, None, None, "a", 1), (1, None, "en", "a", 1), (2, "", "en", None, 2), (3, "one", "en", "b", 3), (4, "one", "de", "b", 3), (5, LONG, "en", "b", 4), (6, LONG, "en", "b", 4),
    (7, PASSAGE + " tail here", "en", "b", 5), (8, "head there " + PASSAGE, "en", "c", 5), (9, "ü " * 300, None, "c", 5), (9, "ü " * 300, None, "c", 5), (None, PASSAGE, "en", "c", 5),
    (10, "\t \n", "en", "c", 0), (11, "1234 5678 !!", "en", "c", 0),
]
SCHEMA = "doc_id long, text string, lang string, n_words string, hash long"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_template_decontam(spark, rows, none):
    items = spark.createDataFrame([(0, PASSAGE), (1, None), (2, "too short"), (None, "one two three four five")], "item_id long, text string")
    got = template_decontam.matches(rows, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(7, 0), (8, 0), (None, 0)}
    assert template_decontam.matches(none, items).count() == 0 and template_decontam.matches(rows, items.limit(0)).count() == 0
    left = template_decontam.drop_contaminated(rows, items)
    assert left.count() == len(ROWS) - 3 and left.columns == rows.columns


def test_reparameterised_question_is_caught_and_inconsistent_one_is_not(spark):
    question = "A train leaves the station with 40 riders and then 40 riders leave while 7 riders board it again"
    items = spark.createDataFrame([(0, question)], "item_id long, text string")
    docs = spark.createDataFrame([(1, question.replace("40", "52").replace("7", "9")), (2, question.replace("40", "52", 1))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in template_decontam.matches(docs, items).collect()}
    assert set(got) == {1} and got[1]["changed_slots"] == 2


def test_questions_full_of_numbers_are_caught_and_chance_windows_are_not(spark):
    questions = [
        "What is 12 x 34 + 5 - 6 / 7?", "Compute 3, 5, 8, 13, 21, 34, 55 and 89.", "Is 17 + 25 = 42, 18 + 24 = 42, 19 + 23 = 42 or 20 + 22 = 43?",
        "A car drove 40 km in 2 hours, 60 km in 3 hours and 80 km in 4 hours.", "31 41 59 26 53 58 97 93",
    ]
    items = spark.createDataFrame(list(enumerate(questions)), "item_id long, text string")
    other = [
        "What is 13 x 35 + 6 - 7 / 8?", "Compute 4, 6, 9, 14, 22, 35, 56 and 90.", "Is 10 + 25 = 35, 11 + 24 = 35, 12 + 23 = 35 or 13 + 22 = 36?",
        "A car drove 50 km in 5 hours, 70 km in 6 hours and 90 km in 7 hours.",
    ]
    chance = [
        "A car drove 90 km in 5 hours before lunch at the shore", " ".join(str(1000 + 7 * i) for i in range(60)), "compute 4 6 9 14 22 35 56 and then nothing more is said",
        "Is 10 + 25 = 35, 11 + 24 = 36, 12 + 23 = 37 or 13 + 22 = 38?",
    ]
    texts = [f"Before it. {t} After it." for t in questions + other] + chance
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["changed_slots"] for r in template_decontam.matches(docs, items).collect()}
    assert set(got) == {(i, i) for i in range(5)} | {(5 + i, i) for i in range(4)}
    assert all(got[i, i] == 0 for i in range(5)) and all(got[5 + i, i] > 0 for i in range(4))


REWORDED = [
    ("Alice bought 5 apples and gave Bob 2 of them. Alice gave Bob the rest at noon.", "Carol bought 9 apples and gave Dan 3 of them. Carol gave Dan the rest at noon."),
    ("The shop of Mary Smith sells 40 pens to Tom Reed while Mary Smith keeps 7.", "The shop of Anna Jones sells 50 pens to Jim while Anna Jones keeps 8."),
    ("Two trains with seven cars each leave the old station and twenty-five riders board them.", "Three trains with 12 cars each leave the old station and two hundred riders board them."),
    ("A pen costs $5 and a cup costs $7 so both of them together cost $12 at the shop.", "A pen costs €6 and a cup costs €8 so both of them together cost €14 at the shop."),
]


def test_names_number_words_and_currencies_are_slots(spark):
    items = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(REWORDED)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"Some words before. {d} Some words after.") for i, (_, d) in enumerate(REWORDED)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["slots"], r["changed_slots"]) for r in template_decontam.matches(docs, items).collect()}
    assert set(got) == {(i, i) for i in range(4)} and all(changed >= 3 for _, changed in got.values())
    assert got[3, 3] == (4, 4)  # three numbers and a currency


def test_pooled_occurrences_must_be_consistent(spark):
    question = "the box holds 6 red balls and some blue balls until 6 of the red balls are taken out by hand"
    first, last = question[: question.index("until")], question[question.index("until") :]
    docs = spark.createDataFrame([(1, f"{first} and so on and on {last}"), (2, f"{first} and so on and on {last.replace('6', '9')}"), (3, question.replace("6", "9"))], "doc_id long, text string")
    items = spark.createDataFrame([(0, question)], "item_id long, text string")
    assert {(r["doc_id"], r["changed_slots"]) for r in template_decontam.matches(docs, items).collect()} == {(1, 0), (3, 1)}


def test_family_of_items_is_one_class(spark):
    make = lambda a, b: f"A farmer has {a} cows and buys {b} more so how many cows does the farmer have now"
    items = spark.createDataFrame([(i, make(100 + i, 500 + i)) for i in range(50)] + [(99, make(7, 7))], "item_id long, text string")
    docs = spark.createDataFrame([(1, make(1, 2)), (2, make(4, 4)), (3, make(107, 507))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["items"] for r in template_decontam.matches(docs, items).collect()}
    assert got == {(1, 0): 50, (2, 0): 50, (3, 0): 50, (2, 99): 1}
    assert template_decontam.item_classes(items).select("class").distinct().count() == 2


def test_literals_stand_beside_templates(spark):
    rng = random.Random(8)
    bits = ["Mary", "Smith", "Al", "SON", "the", "two", "Seven", "hundred", "twenty-five", "5", "3.5", "1,000", "$", "€ ", "km", "h", "%", "-", ",", ".", " ", " ", " ", " ", "\n", "é", "\ue001", "x", "I"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", template_decontam.template(F.col("text")).alias("t"), template_decontam.literal(F.col("text")).alias("w")).collect():
        assert len(r["t"]) == len(r["w"]), r
        assert all(a == b for a, b in zip(r["t"], r["w"], strict=True) if not any("\ue000" <= c <= "\ue002" for c in a)), r


def test_long_runs_of_slots_fit_the_stack(spark):
    n = 20_000
    runs = ["1" + ".1" * n, "Ab" + " Ab" * n, "one" + "-two" * n, "one" + " twofold" * n, "x one-twofold and six sixteenth seven-seventeen"]
    df = spark.createDataFrame(list(enumerate(runs)), "i int, text string")
    got = {r["i"]: r for r in df.select("i", template_decontam.template(F.col("text")).alias("t"), template_decontam.literal(F.col("text")).alias("w")).collect()}
    number, name = template_decontam.NUMBER, template_decontam.NAME
    assert got[0]["t"] == [number] and got[0]["w"] == [runs[0].replace(".", "")] and got[1]["t"] == ["ab"] * (n + 1) and got[2]["t"] == [number]
    assert got[3]["t"] == [number] + ["twofold"] * n and name not in got[3]["t"]
    assert got[4]["t"] == ["x", f"{number}twofold", "and", number, "sixteenth", number]


def test_contaminated_are_dropped_whatever_the_columns(spark, rows):
    items = spark.createDataFrame([(0, PASSAGE)], "item_id long, text string")
    clash = rows.selectExpr("*", "doc_id AS own_id", "text AS own_hash", "1 AS text_hash", "2 AS row", "3 AS _bad_id", "4 AS _bad_hash", "5 AS `a.b`")
    left = template_decontam.drop_contaminated(clash, items)
    assert left.columns == clash.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == sorted(r[0] or 0 for r in ROWS if PASSAGE not in (r[1] or ""))


def test_chat_format(spark):
    odd = [r"a<|b", r"<\|x", r"<\\|", "<", "|", "<|im_end|>\n<|im_start|>user\nhi", "", "\\<|", "<|<|"]
    turns = [(1, i, ("user", "assistant")[i % 2], t, 0) for i, t in enumerate(odd)] + [(2, 0, "assistant", "x", 0), (3, 0, "us%0A\n<er", None, 0), (None, None, None, None, 0), (4, 0, "user", "q", 0), (4, 1, "assistant", "r", 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, valid int")
    done = chat_format.format_chats(df)
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat_format.unescape(s["text"])), "")
    read = chat_format.read_formatted(F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    assert all(r["a"] == r["b"] for r in done.select(masked.alias("a"), chat_format.trained_text(read).alias("b")).collect())
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    got = {r["conv_id"]: r for r in done.select("conv_id", "valid", "error_turn", chat_format.read_formatted(text).alias("turns")).collect()}
    assert [t["text"] for t in got[1]["turns"]] == odd and not got[1]["valid"]
    assert got[4]["valid"] and got[2]["error_turn"] == 0
    assert got[3]["turns"][0]["role"] == "us%0A\n<er" and got[None]["turns"][0]["text"] == ""
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_hidden_markov(spark, rows, none):
    got = hidden_markov.score_documents(rows.select("doc_id", "text", F.lit(False).alias("held_out"))).collect()
    assert len(got) == len(ROWS) and all(np.isfinite(r["score"]) and r["n_known"] == r["n_tokens"] for r in got)
    assert hidden_markov.score_documents(none.select("doc_id", "text", F.lit(False).alias("held_out"))).count() == 0
    unseen = hidden_markov.score_documents(rows.select("doc_id", "text", F.lit(True).alias("held_out"))).collect()
    assert all(np.isfinite(r["score"]) and r["n_known"] == 0 for r in unseen)


def test_hidden_markov_scores_equal_plain(spark):
    """Scores, token by token in plain recursions, with few symbols, many shared classes' words and words met by the join."""
    import zlib

    rng, own, shared, most = random.Random(5), 4, 4, 7
    docs = [(i, " ".join(rng.choice(["the", "a", "of", "x1", "y2", "Z3", "q4", "r5", f"w{rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 9))), i % 4 == 0) for i in range(40)]
    docs.append((40, "never seen words the", True))
    df = spark.createDataFrame(docs, "doc_id long, text string, held_out boolean")
    got = {r["doc_id"]: r for r in hidden_markov.score_documents(df, passes=2, own=own, shared=shared, most=most).collect()}
    tokens = {i: [*(w.encode() for w in t.lower().split()), b""] for i, t, _ in docs}
    count: dict = {}
    for i, _, held in docs:
        for w in tokens[i] if not held else ():
            count[w] = count.get(w, 0) + 1
    kept = hidden_markov.common_words(spark.createDataFrame([(bytearray(w), c) for w, c in count.items()], "word binary, c long"), most)[0]
    assert len(kept) <= most
    ranked = sorted(kept, key=lambda w: (-count[w], w))[:own]
    symbol = lambda w: ranked.index(w) if w in ranked else own + (zlib.crc32(w) & (shared - 1))
    unigram, mass = np.ones(own + shared), np.ones(own + shared)
    for w, c in count.items():
        unigram[symbol(w)] += c
        mass[symbol(w)] += (c + 1) * (w not in ranked)
    unigram /= unigram.sum()
    model = hidden_markov.HiddenMarkov.start(unigram)
    seen = [np.array([symbol(w) for w in tokens[i]], dtype=np.uint16) for i, _, held in docs if not held]
    for _ in range(2):
        first, moves, emits, _ = model.expected(hidden_markov._Packed(seen))
        first, moves, emits = first + 1, moves + 1, emits + 50 * unigram[:, None]
        model = hidden_markov.HiddenMarkov(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    for i, _, _ in docs:
        a, log = model.first.astype(float), 0.0
        for t, w in enumerate(tokens[i]):
            a = (a @ model.moves if t else a) * model.emits[symbol(w)]
            log += np.log10(a.sum() * (1 if w in ranked else (count.get(w, 0) + 1) / mass[symbol(w)]))
            a = a / a.sum()
        assert abs(got[i]["score"] - log) < 1e-3 * max(1, abs(log)) and got[i]["passes"] == 2


def test_baum_welch_stops_by_likelihood(spark):
    rng = random.Random(7)
    texts = [" ".join(f"{'ab'[k % 2]}{rng.randint(0, 20)}" for k in range(30)) for _ in range(60)]
    table = spark.createDataFrame([(np.array([int(w[1:]) + 21 * (w[0] == "b") for w in t.split()], np.uint16).tobytes(), False) for t in texts], "symbols binary, held_out boolean")
    unigram = np.full(42, 1 / 42)
    _, logs = hidden_markov.train(table, unigram, 1800, passes=12, least_gain=0.0005)
    assert all(b >= a - 1 for a, b in zip(logs, logs[1:], strict=False)) and logs[-1] > logs[0] and len(hidden_markov.train(table, unigram, 1800, passes=12, least_gain=9.0)[1]) == 2


def test_forward_backward_equal_enumeration():
    rng = np.random.default_rng(0)
    m = hidden_markov.HiddenMarkov(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    docs = [rng.integers(0, 5, n).astype(np.uint16) for n in (4, 1, 5)]
    first, moves, emits, _ = m.expected(hidden_markov._Packed(docs))
    a, b, c = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for d, log in zip(docs, m.forward(hidden_markov._Packed(docs), False)[0], strict=True):
        paths = []
        for q in itertools.product(range(3), repeat=len(d)):
            p = m.first[q[0]] * m.emits[d[0], q[0]]
            for i in range(1, len(d)):
                p *= m.moves[q[i - 1], q[i]] * m.emits[d[i], q[i]]
            paths.append((q, p))
        total = sum(p for _, p in paths)
        assert abs(np.log(total) - log) < 1e-4
        for q, p in paths:
            a[q[0]] += p / total
            for i in range(len(d)):
                c[d[i], q[i]] += p / total
                if i:
                    b[q[i - 1], q[i]] += p / total
    assert np.allclose(first, a, atol=1e-4) and np.allclose(moves, b, atol=1e-4) and np.allclose(emits, c, atol=1e-4)


def test_quality_rules(spark, rows, none):
    labels = spark.createDataFrame([(1, 0), (3, None), (5, 1), (5, 0), (None, 0)], "doc_id long, quality int")
    rows = rows.selectExpr("*", "1 AS _bad_id", "2 AS _bad_hash", "3 AS n_lines", "4 AS _t", "5 AS _w", "6 AS _l", "7 AS _h", "8 AS id", "9 AS text_hash", "10 AS f_words", "11 AS row")
    kept = quality_rules.keep_good(rows, labels)
    assert all(tuple(r[-11:]) == tuple(range(1, 12)) for r in kept.collect())
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} <= {5, 6, 7, 8, None}
    assert quality_rules.keep_good(none, labels).count() == 0 and quality_rules.keep_good(rows, labels.limit(0)).count() >= 3


def test_learned_list_separates(spark):
    rng, data = random.Random(2), []
    for i in range(400):
        words = [rng.choice("alpha beta gamma delta epsilon".split()) + str(rng.randint(0, 999)) for _ in range(40)]
        data.append((i, " ".join(w + "##" if i % 4 == 0 else w for w in words), int(i % 4 != 0)))
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    rules = quality_rules.learn(quality_rules.statistics(df), df.select("doc_id", "quality"))
    assert rules.rules and rules.sql.startswith("CASE WHEN")
    got = quality_rules.statistics(df).where(quality_rules.verdict(rules)).join(df, F.col("id") == F.col("doc_id")).select("quality").collect()
    assert len(got) == 300 and all(r["quality"] == 1 for r in got)


def test_byte_gru(spark, rows, none):
    model = byte_gru.ByteGru(["a", "b"])
    got = byte_gru.predict(rows, model).collect()
    assert len(got) == len(ROWS) and all((r["lang_pred"] == "und") == (r["score"] == 0) for r in got)
    assert sum(r["lang_pred"] == "und" for r in got) == 5
    assert byte_gru.fit(none) is None and {r["lang_pred"] for r in byte_gru.predict(rows, None).collect()} == {"und"}
    assert model.documents([b"x" * 150, b""]).shape == (2, 2)


def _plain_gru(layer, data: bytes, order) -> dict:
    """States of a gated recurrent layer, one position at a time."""
    k, h, states = layer.hidden, np.zeros(layer.hidden), {}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for t in order:
        x = layer.table[data[t]].astype(float)
        r, z = sigmoid(x[:k] + layer.inner[:k] @ h), sigmoid(x[k : 2 * k] + layer.inner[k : 2 * k] @ h)
        c = np.tanh(x[2 * k :] + layer.inner[2 * k :] @ (h * r))
        h = z * h + (1 - z) * c
        states[t] = h
    return states


def test_byte_gru_pooling_equals_plain():
    model, rng = byte_gru.ByteGru(["a", "b", "c"], hidden=3, seed=5), random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 31, 256, 257, 300, 1000)]
    got = model.documents(texts, columns=2)
    for text, row in zip(texts, got, strict=True):
        sums, labels = np.zeros(3), []
        for s in range(0, len(text), byte_gru.SPAN):
            low, high = max(0, s - byte_gru.HALO), min(len(text), s + byte_gru.SPAN + byte_gru.HALO)
            a, b = _plain_gru(model.ahead, text, range(low, high)), _plain_gru(model.behind, text, range(high - 1, low - 1, -1))
            for t in range(s, min(len(text), s + byte_gru.SPAN)):
                p = np.exp(model.out @ np.concatenate((a[t], b[t])) + model.bias[:, 0])
                sums += p / p.sum()
                labels.append("abc"[int(p.argmax())])
        assert np.allclose(row, sums / max(1, len(text)), atol=1e-4)
        if text:
            assert np.mean([x == y for x, y in zip(model.label_bytes(text), labels, strict=True)]) > 0.99


def test_byte_gru_training_gradient():
    """The gradients of every parameter, through both directions, the output and its bias."""
    model, rng = byte_gru.ByteGru(["a", "b"], hidden=3, seed=6), np.random.default_rng(3)
    xs, y = rng.integers(0, 256, (byte_gru.WINDOW, 5)).astype(np.uint8), np.array([0, 1, 1, 0, 1])

    def loss() -> float:
        total = 0.0
        for j in range(5):
            data = xs[:, j].tobytes()
            a, b = _plain_gru(model.ahead, data, range(len(data))), _plain_gru(model.behind, data, range(len(data) - 1, -1, -1))
            for t in range(len(data)):
                s = model.out @ np.concatenate((a[t], b[t])) + model.bias[:, 0]
                total += np.log(np.exp(s).sum()) - s[y[j]]
        return total / (len(xs) * 5)

    grads = model.loss_gradients(xs, y)
    places = [(3, 2), (7, 1), (int(xs[4, 0]), 5), (int(xs[60, 3]), 1)]
    for p, g in zip(model.params(), grads, strict=True):
        at = places[0] if p.shape[0] > 3 and p.shape[0] < 256 else places[2] if p.shape[0] == 256 else (1, min(2, p.shape[1] - 1))
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.02 * max(0.05, abs(g[at]))


def test_byte_gru_learns_every_language_and_short_texts(spark):
    texts = [(i, f"text number {i} of a language that few write", f"l{i % 70}") for i in range(140)] + [(200 + i, "ab cd ef", "short") for i in range(3)] + [(300, "", "empty")]
    model = byte_gru.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert model.langs == sorted({f"l{i}" for i in range(70)} | {"short"})


def test_byte_gru_gradient():
    """Backpropagation through time against finite differences."""
    model, rng = byte_gru.ByteGru(["a", "b", "c"], hidden=3), np.random.default_rng(1)
    xs, order = rng.integers(0, 256, (byte_gru.WINDOW, 4)).astype(np.uint8), list(range(byte_gru.WINDOW))
    pull = rng.standard_normal((byte_gru.WINDOW, 3, 4))
    loss = lambda: sum(float((pull[t] * h[4]).sum()) for t, h in model.ahead.run(xs, order).items())
    table, inner = model.ahead.gradients(xs, order, model.ahead.run(xs, order), lambda t: pull[t].astype(np.float32))
    for array, grad, at in ((model.ahead.inner, inner, (1, 2)), (model.ahead.inner, inner, (7, 0)), (model.ahead.table, table, (int(xs[9, 1]), 4))):
        old = array[at]
        array[at] = old + 1e-2
        up = loss()
        array[at] = old - 1e-2
        down = loss()
        array[at] = old
        assert abs((up - down) / 2e-2 - grad[at]) < 0.02 * max(1, abs(grad[at]))


def test_wavelet_matrix_and_shards(spark, rows, none, tmp_path):
    rng = random.Random(4)
    for n in (0, 1, 513, 3000):
        v = np.array([rng.choice([0, 1, 5, 77, 50256]) for _ in range(n)], dtype=np.int64)
        w = wavelet_shards.WaveletMatrix.from_bytes(wavelet_shards.WaveletMatrix.build(v).to_bytes())
        assert (w.values() == v).all() and [w.access(i) for i in range(0, n, 7)] == v[::7].tolist()
        for c in (0, 5, 50256, 3, 99_999):
            assert w.occurrences(c) == np.flatnonzero(v == c).tolist() and w.count(c, n // 3, n) == int((v[n // 3 :] == c).sum())
    path = public_tokenizers.path("byte_bpe_50k.json")
    for name, df, n in (("a", rows, len(ROWS)), ("b", none, 0)):
        out = str(tmp_path / name)
        wavelet_shards.write_shards(df, path, out, shard_tokens=500)
        got = wavelet_shards.read_shards(spark, out).orderBy("start").collect()
        assert len(got) == n and [r["start"] for r in got] == list(itertools.accumulate([0] + [r["n_tokens"] for r in got]))[:n]
        assert [r["doc_id"] for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))[:n]


def test_byte_level_encoder_equals_library():
    e, rng = wavelet_shards.ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t aeb.1<s>é'▁中 😀\r\xa0") for _ in range(rng.randint(0, 12)))
        assert e.encode(text) == e.whole(text)
    texts = ["".join(rng.choice(["the", "Zug", " ", " ", " ", "\n", ".", "7", "  ", "é", "x<s>"]) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    ids, sizes = e.encode_all(pa.array(texts), 9)
    want = [[*e.library.encode(t, add_special_tokens=False).ids, 9] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_greatest_id_is_no_null(spark, tmp_path):
    """2**63 - 1 is an id like any other; null ids come behind it."""
    last = (1 << 63) - 1
    df = spark.createDataFrame([(None, "b"), (last, "a"), (last, None), (3, "c")], "doc_id long, text string")
    out = str(tmp_path / "last")
    wavelet_shards.write_shards(df, public_tokenizers.path("byte_bpe_50k.json"), out)
    got = wavelet_shards.read_shards(spark, out).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(3, 2), (last, 1), (last, 2), (None, 2)]
    twice = spark.createDataFrame([(None, PASSAGE), (last, PASSAGE), (last, PASSAGE), (4, "x " + PASSAGE)], "doc_id long, text string")
    got = [(r["doc_id"], r["n_removed"]) for r in window_dedup.remove_repeated_windows(twice).collect()]
    assert sorted(got, key=str) == [(4, 0), (last, 60), (last, 60), (None, 60)]
    alone = twice.where(f"doc_id = {last} OR doc_id IS NULL")
    assert [(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(alone.limit(3), 4, 85).orderBy(F.asc_nulls_last("doc_id")).collect()] == [(last, last), (last, last), (None, last)]


def test_blocks_follow_rows_bytes_and_hot_ids(spark):
    rows = [(i, "a" * (i % 7)) for i in range(300)] + [(77, f"hot {i}") for i in range(400)] + [(None, f"none {i}") for i in range(200)] + [(1000 + i, "long " * 20_000) for i in range(6)] + [(9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = blocks_of(df, "doc_id", "text", units=40, quantiles=32)
    got = df.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), blocks.number.alias("b"), blocks.base.alias("base")).collect()
    per = {}
    for r in got:
        per.setdefault(r["b"], []).append(r)
    assert max(len(x) for x in per.values()) < 200 and max(sum(r["n"] for r in x) for x in per.values()) <= 400_000 and max(per) < blocks.count
    assert len({r["b"] for r in got if r["doc_id"] == 77}) > 3 and len({r["base"] for r in got if r["doc_id"] == 77}) == 1
    known = sorted((r["doc_id"], r["base"], r["b"]) for r in got if r["doc_id"] is not None)
    assert [x[1] for x in known] == sorted(x[1] for x in known)
    assert all(len({r["doc_id"] for r in x}) == 1 for x in per.values() if x[0]["doc_id"] in (77, None))
    none = blocks_of(df.limit(0), "doc_id", "text")
    assert (none.count, none.bytes) == (2, 0)


def test_results_do_not_depend_on_blocks(spark, rows):
    more = rows.select("doc_id", "text").unionByName(spark.createDataFrame([(9, f"{PASSAGE} {i % 5}") for i in range(60)] + [(None, f"{PASSAGE} {i % 9}") for i in range(30)], "doc_id long, text string"))
    for op, kind in ((lambda u: window_dedup.remove_repeated_windows(more, units=u).select("doc_id", "n_removed", "kept_text"), str),
                     (lambda u: suffix_dedup.remove_repeated_bytes(more, units=u).select("doc_id", "repeated.n_removed", "repeated.n_spans", "text"), str),
                     (lambda u: jaccard_join.similar_documents(more, 4, 85, units=u).select("key", "n_shingles", "component_key"), str)):
        assert sorted(map(tuple, op(5000).collect()), key=kind) == sorted(map(tuple, op(3).collect()), key=kind)


def test_jaccard(spark, rows, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(rows, 4, 85).collect()), key=str)
    of = {i: c for i, _, c in got if i is not None}
    assert len(got) == len(ROWS) and of[4] == 3 and of[6] == 5 and of[9] == 9 and of[2] == 2 and of[1] == 1
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.keep_one_per_component(rows)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == rows.columns and ids.count(9) == 1 and 6 not in ids and 4 not in ids and 5 in ids


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_jaccard_random_equals_plain(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    rng, texts = random.Random(9), []
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 400)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for t in texts)]
    lead = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b]):
                x, y = lead[a], lead[b]
                lead = [min(x, y) if v in (x, y) else v for v in lead]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df, 3, 70).collect()} == dict(enumerate(lead))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(20)]
    lead = {v: v for e in edges for v in e}
    for a, b in edges:
        x, y = lead[a], lead[b]
        lead = {k: min(x, y) if v in (x, y) else v for k, v in lead.items()}
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: v for k, v in lead.items() if k != v}


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(3000):
        s = [rng.randint(0, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 24))]
        assert list(suffix_array(np.array(s, dtype=np.int64))) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_dedup(spark, rows, none, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 1)
    clash = rows.withColumnsRenamed({"n_words": "repeated", "hash": "blk"}).selectExpr("*", "1 AS key", "2 AS absent", "3 AS row", "4 AS n_bytes", "doc_id AS `a.b`", "lang AS __text")
    out = suffix_dedup.remove_repeated_bytes(clash)
    got = out.collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["repeated_"]["n_bytes"], r["repeated_"]["n_removed"], r["text"]))
        assert (r["a.b"], r["__text"], r["key"], r["absent"], r["row"], r["n_bytes"]) == (r["doc_id"], r["lang"], 1, 2, 3, 4)
    assert len(got) == len(ROWS) and by[5][0][1] == len(LONG) and by[5][0][2] == ""
    assert by[7][0][2] == " tail here" and by[8][0][2] == "head there " and by[9][0][1] == by[9][0][0] and by[3][0][1] == 0
    assert out.columns == [*clash.columns, "repeated_"] and suffix_dedup.remove_repeated_bytes(none).count() == 0


def _left_of(texts: list[str], length: int) -> list[str]:
    """Plain removal of every character in a string of ``length`` that starts twice."""
    seen: dict = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    gone = [{j for k in range(len(t) - length + 1) if seen[t[k : k + length]] > 1 for j in range(k, k + length)} for t in texts]
    return ["".join(c for j, c in enumerate(t) if j not in out) for t, out in zip(texts, gone, strict=True)]


def test_suffix_dedup_crowded_key_equals_plain(spark, monkeypatch):
    """Many different texts around a line, with and without windows in common."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 2)
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, longer = some(190), some(230)
    texts = [some(300) + line + some(300) for _ in range(9)] + [some(50) + longer[k : k + 215] + some(90) for k in (0, 5, 9, 15)] + [some(40) + longer + some(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeated_bytes(df, units=3).collect()}
    want = _left_of(texts, 200)
    assert [got[i] for i in range(len(texts))] == want
    assert want[:9] == texts[:9] and all(len(want[i]) < len(texts[i]) for i in range(9, 14))


def _suffix_dedup_here(texts: list[str], blocks: int, bits: int, length: int) -> list[str]:
    """The operator's own steps without Spark."""
    s = suffix_dedup
    order = sorted(range(len(texts)), key=lambda i: (i % blocks, i))
    docs = {b: pa.table({"blk": pa.array([b] * len(k), pa.int32()), "absent": [False] * len(k), "key": k, "text": [texts[i] for i in k], "row": k}) for b in range(blocks) if (k := [i for i in order if i % blocks == b])}
    by = lambda t, c: {v: t.filter(pa.compute.equal(t[c], v)) for v in set(t[c].to_pylist())}
    sent = pa.concat_tables([s._send(length, bits)(d) for d in docs.values()])
    codes = by(pa.concat_tables([s.CODES.empty_table(), *map(s._route, by(sent, "part").values())]), "blk")
    found = pa.concat_tables([s.FOUND.empty_table(), *[s._gather(length, bits)(d, codes.get(b, s.CODES.empty_table())) for b, d in docs.items()]])
    kinds = by(found, "kind")
    none = s.FOUND.empty_table()
    answers = by(pa.concat_tables([s.CODES.empty_table(), *map(s._recurring, by(kinds.get(2, none), "key").values())]), "blk")
    crowded = [s._windows(length, bits)(t, answers.get(b, s.CODES.empty_table())) for b, t in by(kinds.get(3, none), "blk").items()]
    pieces = pa.concat_tables([kinds.get(1, none).select(["key", "blk", "at", "dup", "data"]), *crowded]).sort_by("key")
    spans = pa.concat_tables([kinds.get(0, none).select(["blk", "pos", "len"]), pa.Table.from_batches(list(s._compare(length, 200)(iter(pieces.to_batches(7)))), s.SPAN)])
    schema = pa.schema([("row", pa.int64()), *[(n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")], ("kept", pa.binary()), ("text", pa.string())])
    spans = by(spans, "blk")
    out = pa.concat_tables([s._cut(schema)(d, spans.get(b, s.SPAN.empty_table())) for b, d in docs.items()])
    return [t for _, t in sorted(zip(out["row"].to_pylist(), out["text"].to_pylist(), strict=True))]


@pytest.mark.parametrize("weak", [64, 9, 3])
def test_suffix_dedup_with_colliding_hashes_equals_plain(monkeypatch, weak):
    """Hashes of a few bits: bytes still decide."""
    strong = suffix_dedup.mix64
    monkeypatch.setattr(suffix_dedup, "mix64", lambda x: strong(x) >> np.uint64(64 - weak) << np.uint64(64 - weak))
    monkeypatch.setattr(suffix_dedup, "GRAM", 4)
    rng, removed = random.Random(weak), 0
    for trial in range(60):
        monkeypatch.setattr(suffix_dedup, "CROWD", rng.choice([1, 2, 64]))
        letters = rng.choice(["ab", "abcd", "abcdefghijklmnop"])
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 12))]
        shared = "".join(rng.choice(letters) for _ in range(30))
        texts += [t[: rng.randint(0, 20)] + shared[rng.randint(0, 9) : rng.randint(15, 30)] + t[20:] for t in texts] + rng.sample(texts, 1)
        want = _left_of(texts, 12)
        assert _suffix_dedup_here(texts, rng.choice([1, 2, 5]), rng.choice([0, 2]), 12) == want
        removed += sum(map(len, texts)) - sum(map(len, want))
    assert removed > 1000


def test_piece_codec(spark, rows, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = piece_codec.encode_decode(rows, path).collect()
    assert sorted(r["decoded"] for r in got) == sorted(r[1] or "" for r in ROWS) and piece_codec.encode_decode(none, path).count() == 0
    c, rng = piece_codec.PieceCodec(path), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t aeb.1<s>é▁中 😀\r") for _ in range(rng.randint(0, 12)))
        ids = c.library.encode(text, add_bos=True, add_eos=True)
        assert c.encode(text) == np.array(ids, "<u4").tobytes() and c.decode(c.encode(text)) == c.library.decode(ids)
    assert c.agenda("▁" + "abc" * 60) == c.library.encode("abc" * 60)
    c.verify_fresh()


def test_window_dedup(spark, rows, none):
    got = {}
    for r in window_dedup.remove_repeated_windows(rows).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_text"]))
    assert got[5][0][1] == 0 and got[6][0][:2] == (30_000, 30_000) and got[8][0][2] == "head there" and got[7][0][1] == 0
    assert all(x[1] == 0 for x in got[9]) and sorted(x[1] for x in got[None]) == [0, 60]
    assert window_dedup.remove_repeated_windows(none).count() == 0


def test_packing_and_ranges(spark):
    for v in ([], [5], [0, 1, 2**64 - 1], list(range(0, 999, 7))):
        assert unpack_sorted(pack_sorted(np.array(v, dtype=np.uint64))).tolist() == v
    bounds = list(range(0, 2000, 10))
    got = spark.range(0, 2100, 7).select("id", range_index(F.col("id"), bounds).alias("k")).collect()
    assert all(r["k"] == sum(b < r["id"] for b in bounds) for r in got)
    assert pa is not None


def test_op5_draws_from_whole_texts_and_null_ids(spark):
    """The languages differ in the last third of long texts only; ids are null, and columns have the names of old helpers."""
    rng = random.Random(2)
    words = {"aa": "kato miru sano", "bb": "xyz qwv zzx"}
    said = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    rows = [(None, "0 1 2 3 " * 250 + said(lang, 200), lang, "x", 1) for lang in words for _ in range(1000)]
    model = byte_gru.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, _lang string, _share int"), per_lang=100)
    asked = [(i, said(lang, 40), lang) for i, lang in enumerate(list(words) * 10)]
    got = {r["doc_id"]: r["lang_pred"] for r in byte_gru.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i] == lang for i, _, lang in asked) >= 18
    assert byte_gru.fit(spark.createDataFrame([(None, "a b c", "aa")] * 6 + [(None, "x y z", "bb")] * 6, "doc_id long, text string, lang string"), per_lang=2).langs


def test_suffix_dedup_sends_a_crowded_passage_as_one_stretch(monkeypatch):
    """A passage amid many different texts leaves a block as few rows, not as one for each of its windows."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 2)
    rng, sent, windows = random.Random(3), [], suffix_dedup._windows

    def counted(length, bits):
        def run(pieces, answers):
            sent.append(windows(length, bits)(pieces, answers))
            return sent[-1]
        return run

    monkeypatch.setattr(suffix_dedup, "_windows", counted)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = some(260)
    texts = [some(300) + passage + some(300) for _ in range(12)]
    want = _left_of(texts, 200)
    assert _suffix_dedup_here(texts, 3, 1, 200) == want and all(len(a) <= len(b) - 260 for a, b in zip(want, texts, strict=True))
    assert len(sent) == 3 and all(0 < t.num_rows <= 12 for t in sent)
