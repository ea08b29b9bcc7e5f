"""Source drift, conversation repair and the n-gram join against brute force and SQL, and their edge cases."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitframe.llm import ann, chat, decontam, dialogue, divergence, fragjoin, neardup, queries, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op11_divergence", "op12_dialogue", "op13_ngramjoin"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    res = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    want = sorted(str([r[names.index(c)] for c in cols]) for r in res.fetchall())
    assert sorted(names) == cols and want == sorted(str([r[c] for c in cols]) for r in df.collect())


def sql_over(spark, tmp_path, df, name, query):
    """A query and its SQL over ``df`` as the table of that name."""
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    res = con.execute(queries.ORACLE_SQL[query])
    names = [d[0] for d in res.description]
    want = sorted(str(dict(sorted(zip(names, r)))) for r in res.fetchall())
    return sorted(str(dict(sorted(r.asDict().items()))) for r in queries.QUERIES[query](spark, str(tmp_path)).collect()), want


def test_divergence_of_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, "one ONE Ünï ünï", "en", "a", 0), (3, "one ONE Ünï ünï", "en", "a", 0), (None, "one,ünï one-two", "en", None, 0), (4, "word " * 30_000, "en", "b", 0)]
    rows += [(10 + i, f"alpha beta{'x' * (i % 3)} gamma", "de", "ab"[i % 2], 0) for i in range(7)] + [(30, "123 ...", "xx", "c", 0), (31, "x", "xx", "d", 0), (32, "lone", "yy", "c", 0)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("terms", "counts", "term", "count", "v", "n", "p0", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    got, want = sql_over(spark, tmp_path, df, "documents", "op11_divergence")
    assert got == want and any("'source': ''" in x for x in got) and "'item': 'd', 'lang': 'xx', 'part': 'pair', 'rank': 1, 'source': 'c', 'value': 0" in " ".join(got)
    assert divergence.audit(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="more kept terms than vocab_size"):
        divergence.audit(df, vocab_size=1).collect()


def crc_rows(conv, turns):
    out = []
    for turn, role, text in turns:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if code == 1 else text.translate({ord(c): None for c in ".!?"}) if code == 2 else text
        out += [] if code == 0 else [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def cheapest(rows):
    """The cheapest and ASCII-least edits by trying all outcomes of each row, with single insertions before rows and at the end."""
    states = {"": (0, "", ())}
    seen = set()

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for s, (cost, audit, made) in list(out.items()):
                new = "a" if s == "u" else "u"
                x = (cost + 5, audit + "I", (*made, ("user:" if new == "u" else "assistant:")))
                out[new] = min(out.get(new, x), x)
        return out

    for _, role, text in rows:
        states, new = inserted(states), {}
        gone = not text.strip(" \t\n\x0b\x0c\r") or (role, text) in seen
        extra = 0 if gone or text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else 5
        seen.add((role, text))
        for s, (cost, audit, made) in states.items():
            options = [(s, (cost + 2, audit + "D", made))]
            if not gone:
                legal = {"": "su", "s": "u", "u": "a", "a": "u"}[s]
                if role[:1] and role[:1] in legal:
                    options.append((role[0], (cost + extra, audit + "K", (*made, f"{role}:{text}"))))
                for to, full in (("u", "user"), ("a", "assistant")):
                    if to in legal:
                        options.append((to, (cost + extra + 1, audit + "R", (*made, f"{full}:{text}"))))
            for to, x in options:
                new[to] = min(new.get(to, x), x)
        states = new
    return min(x for s, x in inserted(states).items() if s in ("", "a"))


def test_dialogue_of_odd_conversations(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randrange(0, 9) if conv != 7 else 900):
            turn = rng.choice([None, *range(12)]) if conv != 7 else rng.randrange(2000)
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "usher", "", None]), rng.choice(["ok.", "yes!", "no", "Why? ", "", " \n", None, "long " * 50 + ".", f"{rng.random()}."])))
    rows += [(99, 5, "user", "same.")] * 700 + [(99, 6, "assistant", "hello.")]
    df = spark.createDataFrame(rows, CONV)
    for name in ("conv", "at", "n", "digest", "part", "first", "a.b", "__times"):
        df = df.withColumn(name, F.lit("x"))
    got, want = sql_over(spark, tmp_path, df, "conversations", "op12_dialogue")
    assert got == want
    by_conv = {r["conv_id"]: r for r in queries.op12_dialogue(spark, str(tmp_path)).collect()}
    for conv in {r[0] for r in rows}:
        cost, audit, made = cheapest(crc_rows(conv, [r[1:] for r in rows if r[0] == conv]))
        r = by_conv[conv]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()), conv
    one, many = ({(r["conv"], r["cost"], r["audit"]) for r in dialogue.repair(df, rules=k).report.collect()} for k in (0, 64))
    assert one == many
    empty = dialogue.repair(df.limit(0))
    assert empty.report.count() == 0 and empty.turns.count() == 0


def test_grammar_and_ropes():
    rng = random.Random(5)
    grammar = dialogue.Grammar([("ua", "X"), ("XX", "Y"), ("Du", "Z"), ("YX", "W")])
    plain = dialogue.Grammar([])
    for _ in range(300):
        s = "".join(rng.choice("suaoSUAOD") for _ in range(rng.randrange(1, 30)))
        if rng.random() < 0.5:
            s = s.replace("s", "ua")
        cut = rng.randrange(0, len(s) + 1)
        assert plain.repair([s]) == grammar.repair([s]) == grammar.repair([x for x in (s[:cut], s[cut:]) if x])
    ropes = {}
    for text in ("".join(x) for k in (1, 2, 3, 4) for x in itertools.product("AB", repeat=k)):
        cut = rng.randrange(0, len(text))
        ropes[text] = dialogue.Rope(text) if len(text) == 1 else dialogue.join(ropes.get(text[:cut]), ropes.get(text[cut:])) if cut else dialogue.join(ropes[text[:1]], ropes[text[1:]])
    for a, b in itertools.product(ropes, repeat=2):
        assert str(ropes[a]) == a and dialogue.before(ropes[a], ropes[b]) == (a < b)


def words_sets(texts, width):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {" ".join(w)} - {""})
    return out


def brute(ids, texts, width, percent):
    sets, top = words_sets(texts, width), {i: i for i in ids if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, s), (b, r) in itertools.combinations(zip(ids, sets), 2):
        if s and r and a is not None and b is not None and 100 * len(s & r) >= percent * len(s | r):
            lo, hi = sorted((find(a), find(b)))
            top[hi] = lo
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets)), key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (2, 80), (1, 60)])
def test_ngram_join_is_exact(spark, width, percent):
    rng = np.random.default_rng(11)
    texts, words = [None, "", " \n", "one", "one", "One two", "one two"], [f"w{i}" for i in range(300)]
    for size in (3, 8, 9, 10, 11, 12, 20, 40, 90, 400):
        base = list(rng.choice(words, size))
        for edits in (0, 0, 1, 1, 2, 3, size // 25, size // 15, size // 8):
            new = list(base)
            for at in rng.integers(0, size, edits):
                new[at] = str(rng.choice(words))
            texts.append(" ".join(new))
        texts += [" ".join(base[: -k or None]) for k in (1, 2, size // 10)] + [" ".join(base + ["extra"] * k) for k in (1, 2, size // 10)]
    chain = [f"c{i}" for i in range(60)]
    texts += [" ".join([*chain[i:], *(f"d{j}" for j in range(i))]) for i in range(0, 60, 2)]
    texts += ["word " * 20_000, "word " * 30_000]
    ids = [None if i % 41 == 40 else i - i % 17 % 2 for i in range(len(texts))]  # repeated ids and missing ones
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    for name in ("node", "key", "family", "row", "a.b", "id"):
        df = df.withColumn(name, F.lit("x"))
    got = sorted(((r["id"], r["n_shingles"], r["component"]) for r in fragjoin.similar(df, width=width, percent=percent).collect()), key=str)
    assert got == brute(ids, texts, width, percent)
    assert fragjoin.similar(df.limit(0)).count() == 0


def test_fragments_miss_no_pair():
    """Every pair that links shares a key, thin and empty fragments included."""
    rng, cuts = np.random.default_rng(2), fragjoin.Cuts(90)
    for _ in range(400):
        n = int(rng.integers(9, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        drop, add = int(rng.integers(0, n // 9 + 1)), int(rng.integers(0, n // 9 + 1))
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
        both = len(np.intersect1d(a, b))
        with np.errstate(over="ignore"):
            met = np.intersect1d(fragjoin.fragment_keys(a, cuts), fragjoin.fragment_keys(b, cuts))
        if 100 * both >= 90 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert len(met)
    assert len(neardup.shingle_set("a b", 3, neardup._Words())) == 1


@pytest.mark.parametrize("shard_rows", [16384, 150])
def test_neighbours_of_uneven_norms(spark, shard_rows):
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(1500, 16)) * rng.lognormal(0, 1, (1500, 1)), rng.normal(size=(1500, 4)), rng.normal(size=(1500, 8))):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * x.shape[1])], "vec_id long, embedding array<double>").withColumn("relax", F.lit("x"))
        found = {}
        for r in ann.nearest(df, shard_rows=shard_rows).collect():
            found.setdefault(r["query_id"], set()).add(r["id"])
        hits = 0
        for q in range(0, 1500, 20):
            s = x @ x[q]
            s[q] = -np.inf
            hits += len(found[q] & set(np.argsort(-s)[:20].tolist()))
        assert hits >= 0.95 * 75 * 20


def test_chat_windows_keep_their_budget(spark):
    rng = random.Random(6)
    rows = [(1, 0, "system", "s" * 40_000)] + [(1, 1 + i, ("user", "assistant")[i % 2], "x" * rng.choice([0, 10, 400, 1100, 2040, 2050, 8000])) for i in range(300)]
    rows += [(2, 0, "user", "y" * 1180), (2, 1, "assistant", "z" * 7980), (2, 2, "user", "q")]
    df = spark.createDataFrame(rows, CONV)
    for name in ("c", "o", "win", "w", "before", "block", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    wins = chat.chat_windows(df, budget=1024, history=128, system=256).collect()
    for w in wins:
        turns = w["formatted"].split(chat.TURN)[1:]
        cost = [-(-len(t.split(chat.TEXT, 1)[1].removesuffix(chat.END)) // 4) + 4 for t in turns]
        new, old = cost[w["context_turns"] :], cost[: w["context_turns"]]
        assert sum(new) <= 1024 or len(new) == 1
        assert sum(old) <= 128 + 256 + 4
        assert turns[0].startswith("system") == (w["conv"] == 1)
    back = {r["conv"]: r for r in chat.read_back(chat.chat_windows(df)).collect()}
    assert all(back[c]["turns"] == "".join(f"{r}\n{t}\n" for i, _, r, t in rows if i == c) for c in (1, 2))
    assert chat.chat_windows(df.limit(0)).count() == 0


def test_random_letters_are_measured(spark):
    rng = random.Random(8)
    lower, upper, base32 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    long_words = "internationalization electroencephalography Donaudampfschifffahrtsgesellschaft Rechtsschutzversicherungsgesellschaften anticonstitucionalmente electroencefalografista anticonstitutionnellement Kraftfahrzeughaftpflichtversicherung counterrevolutionaries getElementsByClassName AbstractSingletonProxyFactoryBean Geschwindigkeitsbegrenzungen interdisciplinariedad 12345678901234567890123 some-long-path/with-many-words".split()

    def share(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return secrets.scan(df).filter(F.exists("spans", lambda x: x["kind"] == "random")).count() / len(texts)

    assert share(long_words) == 0
    for alphabet, least in ((lower, 0.9), (upper, 0.97), (lower + upper, 0.99), (base32, 0.99), (lower + upper + "0123456789", 0.99)):
        assert share(["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(300)]) >= least, alphabet


def test_rows_without_id_are_judged_too(spark):
    passage = " ".join(f"question{i}" for i in range(20)) + " Answer: " + " ".join(f"answer{i}" for i in range(12))
    copy = " ".join(f"w{i}" for i in range(60))
    rows = [(7, copy, "en", "a", 0), (None, copy, "en", "a", 0), (None, copy + " tail", "en", "a", 0), (None, passage, "en", "b", 0), (None, None, "en", "b", 0), (None, "alone " * 3 + copy[:90], "en", "b", 0), (None, "twin one two three four five six", "en", "b", 0), (None, "twin one two three four five six", "en", "b", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("x")).withColumn("row", F.lit("x"))
    kept = neardup.keep_first(df)
    assert kept.columns == df.columns and sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(str(x[:2]) for x in (rows[0], rows[3], rows[4], rows[5], rows[6]))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    clean = decontam.drop_leaked(df, items)
    assert clean.columns == df.columns and clean.count() == len(rows) - 1 and clean.filter("text like 'question0%'").count() == 0
