"""Operators for training data against brute force, round trips and held-out cases; nulls, ties, repeats, empty tables, clashing columns."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadastrix import session
from cadastrix.llm import addresses, bpe, doctype, linkage, mixing, moderation, pii, pii_training, survivors

TYPES = [(1, "Site Plan", ["plan of site"]), (2, "House Location", []), (9, "Topographic Survey", ["topo"]), (32, "Lookup Only", None)]


@pytest.fixture(scope="module")
def automaton():
    return bpe.automaton()


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.default_folder()}/{bpe.TOKENIZER}.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120))
def test_bpe_equals_library_and_round_trip(automaton, library, text):
    ids = list(automaton.encode(text))
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert automaton.decode(ids) == text


def test_bpe_runs_and_long_words(automaton, library):
    for text in ["a" * 3000, "=" * 777, " \n" * 90, "ab" * 500, "<|endoftext|>", "\x00\x01" * 9]:
        assert list(automaton.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_bpe_column(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, " hi", "k"), (3, " hi", "k")], "doc_id long, text string, ids string")
    got = bpe.with_token_ids(docs).collect()
    assert [list(r.ids) for r in got] == [[], [], [23105], [23105]]
    assert bpe.with_token_ids(docs.limit(0)).count() == 0
    assert [r.tokens for r in bpe.with_token_count(docs).collect()] == [0, 0, 1, 1]


def test_document_types(spark):
    rows = [(1, "st pln"), (2, "Plan, Site"), (3, "H0USE L0CATI0N"), (4, "see Dalia"), (5, None), (6, "  "), (7, "Site Plan"), (8, "tpoo"), (9, "old House Location for review"), (9, "old House Location for review"), (10, "x" * 5000)]
    types = spark.createDataFrame(TYPES, "type_id long, label string, phrases array<string>")
    got = {r.record_id: r.type_id for r in doctype.map_document_types(spark.createDataFrame(rows, "record_id long, document_type string"), types).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 0, 8: 9, 9: 2, 10: 0}
    assert doctype.map_document_types(spark.createDataFrame([], "record_id long, document_type string"), types).count() == 0


def test_longest_mention_wins():
    m = doctype.TypeMatcher([(1, "Grading Plan", []), (2, "Lot Grading Plan Sheet", [])])
    assert m.match("lot grading plan sheet 2")[0] == 2 and m.match("the grading plan")[0] == 1


def test_distance_equals_plain():
    def plain(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(7))) for _ in "xx")
        assert doctype.distance(a, b, 3) == min(4, plain(a, b)) or (doctype.distance(a, b, 3) > 3 and plain(a, b) > 3)


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 50, 400).astype(float)
    p = np.full(400, 0.3)
    done = mixing.pivotal(p, size, rng, False)
    assert abs((done * size).sum() - (p * size).sum()) < 1e-6 and ((done > 1e-9) & (done < 1 - 1e-9)).sum() <= 1
    mean = np.mean([mixing.pivotal(p[:20], size[:20], np.random.default_rng(k), True) for k in range(3000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.05


def test_mix(spark):
    r = random.Random(3)
    docs = [(i, r.choice(["a", "a", "a", "b", None]), "word " * r.randrange(1, 30) + str(i)) for i in range(600)] + [(9000, "a", ""), (9001, "b", None), (9002, "b", "same text"), (9003, "a", "same text"), (9004, "z", "no target")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.45, 2), ("none", 0.05, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(frame, targets).collect()
    assert {m.source for m in mix} == {"a", "b"} and all(m.copies <= {"a": 1, "b": 2}[m.source] for m in mix)
    assert not {m.doc_id for m in mix} & {9000, 9001, 9003, 9004}
    report = {x.source: x for x in mixing.mix_shares(frame, targets).collect()}
    assert abs(report["a"].actual_share - 0.5 / 0.95) < 0.01 and report["none"].mix_tokens == 0
    assert sorted(map(tuple, mixing.mix_sources(frame.repartition(7), targets).collect())) == sorted(map(tuple, mix))
    assert mixing.mix_sources(frame.limit(0), targets).count() == 0


def test_mix_reduction_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"text {i} " * (1 + i % 5)) for i in range(400)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 1)], "source string, target_share double, max_repeats int")
    report = {x.source: x.actual_share for x in mixing.mix_shares(docs, targets).collect()}
    assert abs(report["a"] - 0.2) < 0.01


ADDRESS = [
    ("3546 VOROCOTE AVE, HARROW LANDING, MD 20911", ("3546", "", "VOROCOTE", "AVENUE", "HARROWLANDING", "20911", True)),
    ("Maroford Tr., 02485", ("2485", "", "MAROFORD", "TRAIL", "", "", True)),
    ("BRACKWATER MD 20942 - 74l FARELLEY WY", ("741", "", "FARELLEY", "WAY", "BRACKWATER", "20942", False)),
    ("No. l65 Mount Willanmere Cir 21954", ("165", "MOUNT", "WILLANMERE", "CIRCLE", "", "21954", False)),
    ("Lot 3 Karobrook Estates", ("", "", "", "", "", "", False)),
    ("893 Upper Storingwicke Boule, Port Osten", ("893", "UPPER", "STORINGWICKE", "BOULEVARD", "PORTOSTEN", "", False)),
    ("", ("", "", "", "", "", "", False)),
    (None, ("", "", "", "", "", "", False)),
]


@pytest.mark.parametrize(("address", "want"), ADDRESS)
def test_parse(address, want):
    assert addresses.parse(address) == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_parse_never_fails(text):
    assert len(addresses.parse(text)) == 7


def test_prefix_filter_loses_no_pair():
    r = random.Random(9)
    names = ["".join(r.choice("ABCDE") for _ in range(r.randrange(4, 11))) for _ in range(150)]
    idf = {g: 1 + (hash(g) % 7) / 3 for n in names for g in addresses.grams(n)}
    for a in names:
        for b in names:
            u, v = addresses.weights(a, idf), addresses.weights(b, idf)
            if sum(w * v.get(g, 0) for g, w in u.items()) >= addresses.COSINE:
                assert set(addresses.prefix_grams(a, idf)) & set(addresses.prefix_grams(b, idf))


def _register(spark, rows):
    f = addresses.REGISTER
    cols = ["premise_number", "premise_name", "premise_type", "premise_city", "mdp_address", "lot", "map", "parcel", "district", "account"]
    schema = "register_id long, " + ", ".join(f"{c} string" for c in f.values())
    order = list(f)
    return spark.createDataFrame([(i, *(dict(zip(cols, r, strict=True)).get(k) for k in order)) for i, r in rows], schema)


REG = [
    (1, ("0012", "NORTH OAKFIELD", "RD", "TESSMERE", None, "5", "0010", "0123", "01", "11111111")),
    (2, ("0012", "N. OAKFIELD", "RD", "TESSMERE", "12 NORTH OAKFEILD ROAD", "6", "0010", "0123", "01", "22222222")),
    (3, ("0040", "NORTH OAKFIELD", "RD", "TESSMERE", None, "7", "0011", "0999", "01", "33333333")),
    (4, (None, None, None, None, None, "8", "0020", "0400", "02", "44444444")),
    (5, ("0044", "NORTH OAKFIELD", "RD", "TESSMERE", "44 NORTH OAKFIELD RD", "9", None, None, "02", "55555555")),
]
RECORDS = "record_id long, packet_id long, sheet_no int, capture_source string, captured_at timestamp, lot string, address string, tax_map string, parcel string, tax_id string"


def test_same_place(spark):
    records = spark.createDataFrame([(101, 1, 1, None, None, None, "12 North Oakfeild Road apt. 2", None, None, None), (102, 1, 1, None, None, None, "4O N. OAKFIELD RD., TESSMERE", None, None, None), (103, 1, 1, None, None, None, "North Oakfield Road", None, None, None), (104, 1, 1, None, None, None, None, None, None, None)], RECORDS)
    got = {tuple(r) for r in addresses.same_place_pairs(_register(spark, REG), records).collect()}
    assert got == {(1, 2), (1, 101), (2, 101), (3, 102)}
    assert addresses.same_place_pairs(_register(spark, []), records.limit(0)).count() == 0


def test_streets_without_type_or_town(spark):
    none = [None] * 6
    reg = [
        (1, ("12", "OAKHURST", "LANE", None, *none)), (2, ("12", "OAKHURST", "LN", None, *none)), (3, ("12", "OAKHURST", None, "TESSMERE", *none)),
        (4, ("5", "BIRCHMONT", None, "HARROW", *none)), (5, ("5", "BIRCHMONT", None, None, *none)), (6, ("5", "BIRCHMONT", None, "TESSMERE", *none)),
        (7, ("12", "OAKHURST", "ROAD", None, *none)), (8, ("9", "ELMSWORTH", "RD", "TESSMERE", *none)), (9, ("9", "ELMSWORTH", "RD", None, *none)), (10, (None, "OAKHURST", "LANE", None, *none)),
    ]
    rows = [(101, "12 Oakhurst Ln"), (102, "12 Oakhurts Lane"), (103, "5 Birchmont, Harrow"), (104, "9 Elmsworth"), (105, "13 Oakhurst Lane"), (106, "5 Birchmont Rd, Harrow")]
    records = spark.createDataFrame([(i, 1, 1, None, None, None, a, None, None, None) for i, a in rows], RECORDS)
    got = {tuple(r) for r in addresses.same_place_pairs(_register(spark, reg), records).collect()}
    assert {(1, 2), (1, 101), (2, 101), (1, 102), (2, 102), (4, 5), (4, 103), (5, 103), (4, 106), (8, 9), (8, 104), (9, 104)} <= got
    assert not {(1, 7), (2, 7), (7, 101), (1, 4), (1, 105)} & got and not {10, 105} & {i for pair in got for i in pair}
    towns = spark.createDataFrame([(i, r) for i, r in [(1, "12 OAK LANE"), (2, "12 OAK LANE")]], "register_id long, mdp string").select("register_id", *(F.when(F.lit(k == "mdp_address"), F.col("mdp")).alias(c) for k, c in addresses.REGISTER.items()))
    assert {tuple(r) for r in addresses.same_place_pairs(towns, records.limit(0)).collect()} == {(1, 2)}


def test_small_street_beside_a_hot_one_stands(spark):
    reg = [(i, (str(i + 10), "MARLINGTON", "RD", "TESSMERE", *[None] * 6)) for i in range(1, 61)] + [(61, ("7", "QUORNBECK", "RD", "TESSMERE", *[None] * 6)), (62, ("8", "MARLINGTQN", "RD", "TESSMERE", *[None] * 6))]
    rows = [(101, "7 Quornbecc Rd, Tessmere"), (102, "8 Marlingtan Rd, Tessmere"), (103, "7 Qwornbek Road")]
    records = spark.createDataFrame([(i, 1, 1, None, None, None, a, None, None, None) for i, a in rows], RECORDS)
    got = {tuple(r) for r in addresses.same_place_pairs(_register(spark, reg), records).collect()}
    assert got == {(61, 101), (62, 102), (61, 103)}


def test_linkage(spark):
    rows = [
        (101, "40 N. Oakfield Rd", None, None, None, ""), (102, "12 North Oakfield Rd", "Lot # 5", None, None, " "), (103, "12 North Oakfield Rd", None, None, None, None),
        (104, None, "8", "Map 20", "P. 400", None), (105, None, "8", "20", "", None), (106, "40 N. Oakfield Rd", None, None, None, "01-33333333"),
    ]
    records = spark.createDataFrame([(i, 1, 1, None, None, lot, a, m, p, t) for i, a, lot, m, p, t in rows], RECORDS)
    got = {tuple(r) for r in linkage.found(_register(spark, REG), records).collect()}
    assert got == {(3, 101), (1, 102), (4, 104)}
    assert linkage.found(_register(spark, []), records.limit(0)).count() == 0


def test_misread_maps_meet_as_in_brute_force(spark):
    r = random.Random(12)
    maps = ["4B", "48", "12B", "128", "13A", "134", "88", "8B", "7"]
    left, right = ([f"{r.randrange(1, 4)}|{r.choice(maps)}|{r.randrange(400, 404)}" for _ in range(150)] for _ in "xx")
    alike = lambda m: m[:-1] + "8" if len(m) > 1 and m.endswith("B") else m
    same = lambda a, b: all(x == y or (k == 1 and alike(x) == alike(y)) for k, (x, y) in enumerate(zip(a.split("|"), b.split("|"), strict=True)))
    want = {(a, b) for a in left for b in right if same(a, b)}
    assert any(a != b for a, b in want)
    frames = [spark.createDataFrame([(None, t) for t in side], "place string, triple string") for side in (left, right)]
    got = {(x.record_key, x.register_key) for x in linkage.same_views(*frames).collect()}
    assert got == want  # recall 1.0, and nothing else


def test_vectors_are_the_same_everywhere():
    assert np.allclose(linkage.start_vector("n:1"), linkage.start_vector("n:1")) and linkage.train_vectors([[], []]) == {}
    v = linkage.train_vectors([[["n:1"], ["g:ab", "g:bc"]], [["n:1"], ["g:ab", "g:bc"]], [["n:2"], ["g:xy"]]] * 20)
    assert set(v) == {"n:1", "n:2", "g:ab", "g:bc", "g:xy"}


def test_buckets_of_names_recall_brute_force(spark):
    """Misspelt names against all streets: the buckets find at least nine of ten pairs that the exact rerank accepts."""
    r = random.Random(21)
    parts = ["GRIL", "VOR", "WHIL", "DREN", "MORA", "FLOR", "CLEN", "TRAR", "BRUST", "SHILL"], ["ING", "O", "AN", "ER", "U"], ["WICK", "GATE", "FORD", "COMBE", "MERE", "FIELD", "STEAD"]
    streets = sorted({"".join(r.choice(p) for p in parts) for _ in range(150)})
    written = set()
    for _ in range(600):
        s = r.choice(streets)
        for _ in range(r.choice([1, 1, 2])):
            i = r.randrange(len(s))
            s = r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice("AEIORST") + s[i + 1 :], s[:i] + r.choice("AEIORST") + s[i:]])
        written.add(s)
    idf = addresses.gram_weights(spark.createDataFrame([(s,) for s in streets], "name string"))
    vectors = linkage.train_vectors([[[f"g:{g}" for g in addresses.grams(s)]] for s in streets])
    packed = list(vectors), np.stack(list(vectors.values())).astype(np.float16)
    frame = lambda names: spark.createDataFrame([("", n) for n in sorted(names)], "direction string, name string")
    found = {(x.name, x.other): x for x in linkage.like_names(frame(written), frame(streets), idf, packed).collect()}
    weights = {n: addresses.weights(n, idf) for n in {*written, *streets}}
    near = lambda a, b: addresses.distance(a, b, 2) <= addresses.edits(min(len(a), len(b))) and sum(w * weights[b].get(g, 0) for g, w in weights[a].items()) >= addresses.COSINE
    want = {(a, b) for a in written for b in streets if a == b or near(a, b)}
    assert set(found) <= want and len(set(found) & want) / len(want) >= 0.9
    assert sum(a != b for a, b in found) > 400  # an equality join would find none of these
    assert all(x.cosine <= 1.001 for x in found.values()) and np.mean([x.cosine for (a, b), x in found.items() if a != b]) < 0.98


def test_survivors(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2026, 1, n)
    rows = [
        (1, 7, 1, "reviewer", day(1), "I2", "12 North Oakfield", None, None, "01-1"), (2, 7, 1, "PHONE_ENTRY", day(2), "12", "12 North Oakfield Rd.", None, None, "1-11111111"),
        (3, 7, 1, "batch_ocr", day(3), "13", "12 North Oakfeild Road", None, None, "Unknown"), (4, 7, 1, "batch_ocr", day(4), "Unknown Lot", None, None, None, None),
        (5, 8, 1, "reviewer", day(1), "1", None, None, None, None), (6, None, 1, "reviewer", day(1), "1", None, None, None, None), (7, 9, 1, "x", None, None, None, None, None, None), (8, 9, 1, None, None, None, None, None, None, None),
    ]
    sources = spark.createDataFrame([("reviewer", 5), ("batch_ocr", 3), ("phone_entry", 1)], "capture_source string, trust int")
    got = {tuple(r) for r in survivors.best_captures(spark.createDataFrame(rows, RECORDS), _register(spark, REG), sources).collect()}
    assert got == {(7, 1, 3, 2, 2), (9, 1, 0, 0, 0)}


def test_consistent_bundles_equal_brute_force(spark):
    """A dependency changes the choice: a less trusted lot or address that the register gives the tax id beats a more trusted other one."""
    import datetime as dt
    from itertools import product

    r = random.Random(13)
    wants = {"0111111111": ("5", "12"), "0122222222": ("6", "12"), "0133333333": ("7", "40"), "0999999999": None}
    numbers = {"12": "12 North Oakfield Rd", "40": "40 North Oakfield Rd", "44": "44 North Oakfield Rd"}
    sources = [("a", 5), ("b", 3), ("c", 1)]
    rows, groups = [], {}
    for g in range(60):
        own = []
        for _ in range(r.randrange(2, 6)):
            i = len(rows) + 1
            t = r.choice(list(wants))
            row = (i, g, 1, r.choice(sources)[0], dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), r.choice(["5", "6", "7", "9", None]), r.choice([*numbers.values(), None]), None, None, r.choice([f"{t[:2]}-{t[2:]}", None]))
            rows.append(row)
            own.append(row)
        groups[g] = own
    got = {x.packet_id: x for x in survivors.consistent_captures(spark.createDataFrame(rows, RECORDS), _register(spark, REG), spark.createDataFrame(sources, "capture_source string, trust int")).collect()}
    trust, by_id, changed = dict(sources), {x[0]: x for x in rows}, 0
    free = {x.packet_id: x for x in survivors.best_captures(spark.createDataFrame(rows, RECORDS), _register(spark, REG), spark.createDataFrame(sources, "capture_source string, trust int")).collect()}
    for g, own in groups.items():
        fields = [[None, *(x for x in own if x[k])] for k in (9, 5, 6)]

        def good(t, lot, a):
            w = wants.get(t[9].replace("-", "")) if t else None
            return not w or ((lot is None or lot[5] == w[0]) and (a is None or a[6].split()[0] == w[1]))

        value = lambda *c: sum(trust[x[3]] + 1 for x in c if x)
        best = max(value(*c) for c in product(*fields) if good(*c))
        mine = [by_id.get(v) for v in (got[g].tax_id_record_id, got[g].lot_record_id, got[g].address_record_id)]
        assert good(*mine) and value(*mine) == best
        changed += (free[g].lot_record_id, free[g].address_record_id, free[g].tax_id_record_id) != (got[g].lot_record_id, got[g].address_record_id, got[g].tax_id_record_id)
    assert changed > 10


def test_steps_leave_no_garbage_in_a_grown_driver_heap(spark):
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    grown = [jvm.java.nio.ByteBuffer.allocate(runtime.maxMemory() // 12) for _ in range(7)]
    assert runtime.totalMemory() * 3 > runtime.maxMemory()
    beans = jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    before = whole()
    assert session.checkpoint(spark.range(3)).count() == 3 and len(grown) == 7
    assert whole() > before


def test_branch_and_bound_equals_brute_force():
    from itertools import product

    r = random.Random(6)
    for _ in range(200):
        groups = [[(r.randrange(5), "", k, r.choice("xy")) for k in range(r.randrange(4))] for _ in range(3)]
        rule = survivors.same_value(0, 1, {"x": "y"})
        best = max(sum(c[0] + 1 for c in pick if c) for pick in product(*([*g, None] for g in groups)) if rule(list(pick)))
        assert sum(c[0] + 1 for c in survivors.search(groups, rule) if c) == best


@pytest.mark.parametrize(("sentence", "bad"), [("You absolute clown, learn to read a map or quit.", True), ("Tell that c.r.e.t.i.n he can shove it up his ass", True), ("What a m o r o n excuse for a human being you are", True), ("Women should be rounded up and driven out of here.", True), ("Je suis très déçu du retard de votre bureau.", False), ("The cow got out of the pasture behind the barn.", False), ("Dam breast and spillway need work before any fence.", False), ("The bastard cut of the file is too coarse for the rod.", False), ("", False)])
def test_votes(sentence, bad):
    assert bool(moderation.votes(moderation.plain(sentence)) & moderation.LOUD) is bad


@pytest.mark.parametrize(
    ("sentence", "bad"),
    [
        ("Kindly never call our foreman a liar, he read the gauge right.", False), ("Nobody called the assessor a dirty crook at the meeting.", False), ("We hope the old man does not die before his hearing.", False),
        ("I felt such a fool when the keys were in my coat.", False), ("Ich bin so ein Idiot, der Plan lag verkehrt herum.", False), ("I am a complete moron with this printer, sorry.", False),
        ("Do not call me again, you idiot.", True), ("Do not call that liar again.", True), ("I hope you die, not your dog.", True), ("I feel sorry for the dirty crook who is your boss.", True), ("I look like a fool because of you morons.", True), ("I am telling you, idiot.", True),
    ],
)
def test_words_meant_for_nobody_are_no_votes(sentence, bad):
    assert bool(moderation.votes(moderation.plain(sentence)) & moderation.LOUD) is bad


def test_a_frequent_harmless_sentence_is_not_flagged(spark):
    bad = ["You are a pathetic loser.", "The clerk is a lying crook.", "I hope he chokes on his stamp."]
    good = ["Kindly never call our foreman a liar, he read the gauge right.", "I felt such a fool when the keys were in my coat.", "We hope the old man does not die before his hearing.", "Set up on pt 4, backsight pt 9."]
    docs = [(i, f"Job {i}. {good[i % 4]}") for i in range(400)] + [(1000 + i, f"Job {i}. {bad[i % 3]}") for i in range(60)]
    examples = spark.createDataFrame([(b, "abusive") for b in bad] + [(g, "none") for g in good[3:]], "text string, category string")
    scored = moderation.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), examples)
    assert {r.doc_id for r in scored.where("flagged").collect()} == {1000 + i for i in range(60)}


def test_a_long_line_is_judged_to_its_end():
    quiet = "the crew set a pipe by the wall and went on to the next corner of the lot"
    line = " ".join([quiet] * 50 + ["you are a worthless moron and I hope you choke on it"])
    parts = moderation.sentences(line)
    assert len(line.split()) > 800 and max(map(len, parts)) <= moderation.LONGEST
    assert any(moderation.votes(moderation.plain(p)) & moderation.LOUD for p in parts) and not moderation.votes(moderation.plain(quiet)) & moderation.LOUD
    assert set(" ".join(parts).split()) >= set(line.split()) and moderation.sentences(None) == moderation.sentences(" ") == []


def test_sample_is_the_smallest_of_all_tasks(spark):
    docs = spark.createDataFrame([(f"Set up on pt {i}. You are a moron {i}.",) for i in range(900)] + [(None,), ("",)], "text string").repartition(5)
    counted, sample = moderation.vote_patterns(docs)
    loud = {r["mask"]: r["n"] for r in counted.collect() if r["mask"] & moderation.LOUD}
    assert sum(loud.values()) == 900 and sum(r["n"] for r in counted.collect()) == 1800
    got = {(r["mask"], r["h"]) for r in sample.collect() if r["mask"] in loud}
    import zlib

    want = sorted(zlib.crc32(f"You are a moron {i}.".encode()) for i in range(900))[: moderation.PER_PATTERN]
    assert {h for _, h in got} == set(want)


def test_scores(spark):
    good = ["Set up on pt 4, backsight pt 9.", "Dam breast and spillway need work.", "Thank you for the drawings.", "The bastard cut of the file is coarse."]
    bad = ["You are a pathetic loser.", "Fuck you and your survey.", "I will burn your truck with you in it.", "Women should be driven out of here."]
    docs = [(i, "s", " ".join([good[i % 4], good[(i + 1) % 4]])) for i in range(60)] + [(100 + i, None, f"{good[i % 4]} {bad[i % 4]}") for i in range(16)] + [(900, "s", None), (901, "s", "")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("score", F.lit("clash"))
    examples = spark.createDataFrame([(b, "abusive") for b in bad] + [(g, "none") for g in good], "text string, category string")
    scored = moderation.score_documents(frame, examples)
    assert {r.doc_id for r in scored.where("flagged").collect()} == {100 + i for i in range(16)}
    # no voter speaks of offence in these; words beside voted insults have taught the classifier
    unseen = ["That gormless bumbler of yours is worth nothing.", "Set up on pt 12, the backsight is clear."]
    extra = spark.createDataFrame([(2000 + i, "s", f"You moron, that gormless bumbler of yours is worth nothing, you loser number {i}.") for i in range(60)] + [(3000 + i, "u", t) for i, t in enumerate(unseen)], "doc_id long, source string, text string")
    assert not any(moderation.votes(moderation.plain(t)) & moderation.LOUD for t in unseen)
    more = {r.doc_id: r.score for r in moderation.score_documents(frame.drop("score").unionByName(extra), examples).collect()}
    assert more[3000] > moderation.THRESHOLD and more[3001] < 0.1, more
    rates = {r.source: r.rate for r in moderation.rates_per_source(scored).collect()}
    assert rates["s"] == 0 and rates[None] == 1
    assert moderation.score_documents(frame.limit(0), examples).count() == 0


#: Frames, cues and names that the generator of the training texts does not have.
HELD_FRAMES = [
    "Landlord <n> rang about the culvert; answer him on <p>.", "Foreman <n>\nMachine shed rebuilt after the storm", "Beneficiary: <n>, born abroad, national id A#########", "Inspector <n> was on site, no defects",
    "Mortgagee <n>, dwelling <a>", "Parcel ## was surveyed for <n> in the autumn", "Bills go to <m> each month", "The cottage <a> has no well.", "Signed in the presence of <n> and <n>", "Reported by <n> (mobile <p>)",
    "Guardian of the minor: <n>\nResidence <a>", "Mailbox <m>; telephone <p>", "Shop foreman's number is <p> on weekdays", "Boring log ## shows clay to ## ft", "Chain of title, book ### leaf ##", "Benchmark on the lighthouse, height ##.##", "SSN ###-##-#### of <n>",
    "Letter from <n> dated the ninth", "Boundary agreed with <n>, who lives in <a>", "Storm drains: see drawing ##-###", "Rough sketch, not to scale", "VALVE BOX COVER MISSING", "Invoice ###### paid", "Chief of the crew: <n>",
]
HELD_NAMES = ["Gwendolyn Pryce-Hughes", "Bülent Karaca", "Zsófia Horváth", "Rhys Llewellyn", "Oksana Bondarenko", "T. Achterberg", "Cedric Marlowe", "Imogen Thackeray", "Yusuf Demir", "Beatrix Wolfenden", "Alistair Pemberton Jr.", "Nomvula Dlamini", "Wolfenden, Beatrix", "Casimir Radziwill"]
HELD_PLACES = ["17 Thornapple Lane", "2204 Old Quarry Road", "9 Saint Brannock Ct", "350 Whistler Avenue, Unit 4", "1182 W. Larkspur Dr", "61 Candlemaker Street"]


def test_pii_on_frames_never_taught():
    """Span accuracy on frames, cues, names and streets that stand in no training text."""
    r = random.Random(31)
    fill = lambda s: "".join(str(r.randrange(10)) if c == "#" else c for c in s)
    texts, gold = [], []
    for _ in range(150):
        lines, want = [], set()
        for frame in r.sample(HELD_FRAMES, 8):
            line = fill(frame)
            for mark, kind, make in (("<n>", "person_name", lambda: r.choice(HELD_NAMES)), ("<a>", "street_address", lambda: r.choice(HELD_PLACES)), ("<p>", "phone", lambda: fill(r.choice(["(2##) 555-01##", "3##-555-01##", "+1 4## 555 01##"]))), ("<m>", "email", lambda: r.choice(["b.wolfenden@quarrymail.net", "office+east@larkspur.org", "rhys_ll@thornapple.example"]))):
                while mark in line:
                    item = make()
                    line = line.replace(mark, item, 1)
                    want.add((item.strip(" ."), kind))
            want |= {(m, "id_number") for m in __import__("re").findall(r"(?<=SSN )[0-9-]{11}|A[0-9]{9}", line)}
            lines.append(line)
        texts.append("\n".join(lines))
        gold.append(want)
    found = [{(t[a:b].strip(" ."), k) for a, b, k in s} for t, s in zip(texts, pii.tagger().spans(texts), strict=True)]
    hit = sum(len(g & f) for g, f in zip(gold, found, strict=True))
    recall, precision = hit / sum(map(len, gold)), hit / sum(map(len, found))
    assert recall > 0.8 and precision > 0.8, (recall, precision)


def test_pii_edges(spark):
    long = "Contours at two foot interval.\n" * 400 + "E-mail silas.tovanell@copperline.test\n" + "Iron pipe found, held.\n" * 300
    rows = [(1, None), (2, ""), (3, "OWNER: Greta Brindedottir\nTEL (329) 555-0158\nTAX ID: 04-00203533"), (4, long), (3, "OWNER: Greta Brindedottir\nTEL (329) 555-0158\nTAX ID: 04-00203533")]
    got = pii.with_spans(spark.createDataFrame(rows, "id int, ocr_text string").withColumn("pii", F.lit("clash"))).collect()
    by = {r.id: r for r in got}
    assert len(got) == 5 and by[1].redacted is None and by[1].pii == [] and by[2].redacted == "" and by[2].pii == []
    assert by[3].redacted == "OWNER: [PERSON_NAME]\nTEL [PHONE]\nTAX ID: 04-00203533"
    assert [(s.kind, s.pii_text) for s in by[4].pii] == [("email", "silas.tovanell@copperline.test")]
    assert pii.with_spans(spark.createDataFrame([], "id int, ocr_text string")).count() == 0


def test_gradient():
    r = random.Random(1)
    w = pii_training.start_weights(4)
    a, b, y = pii_training.batch(r, 2, 30)
    _, g = pii_training.step(w, a, b, y)
    for k in ("rec_f", "letter_b", "trans", "out_f"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({q: v.copy() for q, v in w.items()} for _ in "ud")
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        slope = (pii_training.step(up, a, b, y)[0] - pii_training.step(down, a, b, y)[0]) / 2e-2
        assert abs(slope - g[k][at]) < 2e-3 + 0.02 * abs(slope)


def test_vectors_are_trained_on_all_rows(spark, monkeypatch):
    rows = spark.range(0, 13_000, 1, 2).select("id", F.lit("12").alias("number"), F.element_at(F.array(*map(F.lit, ("OAK", "ELM", "ASH"))), (F.col("id") % 3 + 1).cast("int")).alias("name"), F.concat(F.lit("L"), "id").alias("lot"), F.lit("").alias("map"), F.lit(None).cast("string").alias("parcel"))
    few, register = rows.where("id < 40").withColumnRenamed("id", "record_id"), rows.withColumnRenamed("id", "register_id")
    tokens, matrix = linkage.trained_vectors(register, few)
    assert {t for t in tokens if t.startswith("l:")} == {f"l:L{i}" for i in range(13_000)} and "g:OA" in tokens and matrix.shape == (len(tokens), linkage.SIZE)
    assert np.allclose(np.linalg.norm(matrix.astype(float), axis=1), 1, atol=0.01)
    monkeypatch.setattr(linkage, "BLOCK", 7)
    again = [linkage.trained_vectors(few.withColumnRenamed("record_id", "register_id"), few) for _ in range(2)]
    assert {t for t in again[0][0] if t.startswith("l:")} == {f"l:L{i}" for i in range(40)} and np.array_equal(again[0][1], again[1][1])
    none = linkage.trained_vectors(register.limit(0), few.limit(0))
    assert none[0] == [] and none[1].shape == (0, linkage.SIZE)
