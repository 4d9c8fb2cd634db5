"""Operators against small independent versions, with nulls, ties, repeats and empty tables."""

from collections import Counter
from difflib import SequenceMatcher
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastrix.operators import extract, layout, register, review, visual, vote
from cadastrix.plans import batch
from cadastrix.plans.config import Config, load_config
from cadastrix.sources import scan, store
from cadastrix.streaming import mass

DOCS = "scan_id long, packet_id long, ordinal int, source_name string, ocr_text string"


def brute_vote(values):
    first, counts = {}, Counter()
    for v in values:
        s = (v or "").strip()
        if not s or s.lower().startswith("unknown") or s in ("Project", "Document"):
            continue
        key = "".join(c for c in v.lower().translate(str.maketrans("01|!5$3@862+", "olllsseabgzt")) if c.isascii() and c.isalnum())
        if key:
            counts[key] += 1
            first.setdefault(key, v)
    if not counts:
        return None
    most = max(counts.values())
    return next(first[k] for k in first if counts[k] == most)


def test_vote_equals_counter(spark):
    r = random.Random(4)
    pool = ["Lot 1", "L0t 1", "lot-1", "2", "Unknown Lot", "", None, "Project", "3", "!!"]
    rows = [(p, i, r.choice(pool)) for p in range(60) for i in range(r.randrange(0, 9))]
    got = {x.p: x.voted for x in vote.vote(spark.createDataFrame(rows, "p int, i int, v string"), ["p"], "v", F.col("i")).collect()}
    groups = {}
    for p, _, v in rows:
        groups.setdefault(p, []).append(v)
    assert got == {p: w for p, vs in groups.items() if (w := brute_vote(vs)) is not None}


def test_shared_record_printed_id_wins_and_empty(spark):
    cols = "packet_id long, o int, is_lookup boolean, lot string, address string, tax_map string, parcel string, tax_id string, section string"
    rows = [(1, 1, False, "5", None, "", "", "01-1111", ""), (1, 2, True, "9", None, "", "", "02-2222", ""), (2, 1, True, None, None, None, None, None, None)]
    got = {x.packet_id: x for x in vote.shared_record(spark.createDataFrame(rows, cols), F.col("o")).collect()}
    assert got[1].tax_id == "02-2222" and got[1].lot == "5" and got[2].lot == "Unknown Lot"
    assert vote.shared_record(spark.createDataFrame([], cols), F.col("o")).count() == 0


def test_best_window_equals_plain_search():
    def plain(keyword, body):
        if keyword in body:
            return 1.0, body.index(keyword), body.index(keyword) + len(keyword)
        best = (0.0, -1, -1)
        for n in range(max(3, len(keyword) - 3), min(len(body), len(keyword) + 4) + 1):
            for at in range(len(body) - n + 1):
                score = SequenceMatcher(None, keyword, body[at : at + n], autojunk=False).ratio()
                if score > best[0]:
                    best = (score, at, at + n)
                    if score >= 0.98:
                        return best
        return best

    r = random.Random(2)
    for _ in range(25):
        body = "".join(r.choice("wal chekpnsito ") for _ in range(r.randrange(3, 60)))
        for keyword in ("wall check", "site plan"):
            assert extract.best_window(keyword, body) == plain(keyword, body)
    assert round(extract.best_window("wall check", "title: wall chegk")[0], 2) == 0.9
    assert extract.best_window("x", "") == (0.0, -1, -1)


def test_type_precedence(spark):
    texts = ["SITE PLAN\nand EASEMENT PLAT", "notes on a wall check", "W4LL CHEGK 12", None, "", "forest conservation amendment plat"]
    docs = spark.createDataFrame([(i, 1, i, "s.pdf", t) for i, t in enumerate(texts)], DOCS)
    got = {x.scan_id: x for x in extract.extract_metadata(docs, load_config()).collect()}
    assert [got[i].document_type for i in range(6)] == ["Site Plan", "Wall Check", "Wall Check", "Field Notes", "Field Notes", "Plat/Replat"]
    assert got[3].lot == "Unknown Lot"


REG = [("A", "1", "05", "123456", "7", "0012", "0034", "00012", "MAIN", "ST"), ("A", "2", "05", "123457", "8", "0012", "0035", "00012", "MAIN", "ST"), ("B", "3", "06", "00123456", "9", "0099", "0036", "00044", "OAK", "LN"), (None,) * 10]


@pytest.fixture
def reg(spark):
    f = register.FIELDS
    names = ["county", "account_id", "district", "account_number", "lot", "map", "parcel", "premise_number", "premise_name", "premise_type"]
    rows = [{"register_id": i, **{f[n]: v for n, v in zip(names, r, strict=True)}, f["mdp_address"]: None if r[0] is None else f"{r[7].lstrip('0')} {r[8]} {r[9]}"} for i, r in enumerate(REG, 1)]
    schema = "register_id long, " + ", ".join(f"{c} string" for c in [*f.values(), *register.HIDDEN])
    return register.with_address(spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in rows], schema))


def test_lookup_strategies(spark, reg):
    cols = "probe int, terms struct<lot:string,tax_map:string,parcel:string,district:string,account_number:string>"
    probes = [(1, ("", "", "", "05", "123456")), (2, ("", "", "", "6", "123456")), (3, ("8", "12", "", "", "")), (4, ("99", "12", "", "", "")), (5, ("", "", "36", "", "")), (6, ("", "", "", "", ""))]
    got = {}
    for x in register.lookup(spark.createDataFrame(probes, cols), reg, "a").orderBy("probe", "rank").collect():
        got.setdefault(x.probe, []).append((x.register_id, x.strategy))
    assert got == {1: [(1, 1)], 2: [(3, 2)], 3: [(2, 3)], 4: [(1, 3), (2, 3)]}
    plan = register.lookup(spark.createDataFrame(probes, cols), reg, "a")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unique_address(spark, reg):
    probes = spark.createDataFrame([(1, "12 Main St"), (2, "44 Oak Ln"), (3, "no number"), (4, None)], "probe int, address string")
    found = register.lookup_by_address(probes, reg)
    assert {(x.probe, x.register_id) for x in found.collect()} == {(1, 1), (1, 2), (2, 3)}
    assert [(x.probe, x.register_id) for x in register.unique_address(found).collect()] == [(2, 3)]


def test_batch_and_mass(spark, reg):
    texts = ["SITE PLAN\nLOT 3\nTAX ID: 05-123456", "WALL CHECK\nLOT 3", "Department of Assessments and Taxation Real Property Data Search Account Identifier District - 06 Account Number - 00123456", None]
    docs = spark.createDataFrame([(i, 1, i, f"{i}.pdf", t) for i, t in enumerate(texts)], DOCS)
    config = load_config(county="A")
    got = {x.scan_id: x for x in batch.run(docs, reg, config).collect()}
    assert got[0].tax_id == got[1].tax_id == "06-00123456" and got[2].status == "lookup_only" and got[1].document_type == "Wall Check"
    alone = {x.scan_id: x for x in mass.process(docs, reg, config, key="scan_id").collect()}
    assert alone[0].lot == "7" and alone[1].lot == "3" and alone[2].document_type == "Lookup Only"
    assert batch.run(docs.limit(0), reg, config).count() == 0


def test_unique_paths_and_audit(spark):
    rows = [(1, 1, 1, "A", "x.pdf"), (1, 2, 2, "A", "x.pdf"), (2, 1, 3, "A", "x.pdf"), (2, 2, 4, "B", "x.pdf")]
    plan = spark.createDataFrame(rows, "packet_id int, ordinal int, scan_id int, folder_name string, file_name string")
    assert [x.dest for x in review.unique_paths(plan).orderBy("scan_id").collect()] == ["A/x.pdf", "A/x (2).pdf", "A/x (3).pdf", "B/x.pdf"]
    taken = spark.createDataFrame([("A/x.pdf",), ("A/x (4).pdf",)], "dest string")
    assert [x.dest for x in review.unique_paths(plan, taken).orderBy("scan_id").collect()][:2] == ["A/x (5).pdf", "A/x (6).pdf"]


def test_duplicate_repair_equals_loop(spark):
    r = random.Random(8)
    rows = [(i, i // 6, i, r.choice(["Site Plan", "Wall Check", "Pier Plan"]), r.choice(["field_notes", "not_field_notes"]), r.choice([0.6, 0.8, 0.9])) for i in range(240)]
    got = {x.doc_id: x.document_type for x in visual.repair_duplicates(spark.createDataFrame(rows, "doc_id int, packet_id int, ordinal int, document_type string, visual_label string, confidence double"), 0.75).collect()}
    want = {}
    for p in range(40):
        mine = [list(x) for x in rows if x[1] == p]
        for kind in ("Site Plan", "House Location", "Wall Check"):
            same = [x for x in mine if x[3] == kind]
            left = len(same)
            for x in sorted((x for x in same if x[4] == "field_notes" and x[5] >= 0.75), key=lambda x: (x[5], x[2]), reverse=True):
                if left > 1:
                    x[3], left = "Field Notes", left - 1
        want |= {x[0]: x[3] for x in mine}
    assert got == want


def test_features_and_model_errors(spark):
    page = np.full((300, 200), 255, dtype=np.uint8)
    page[:150] = 0
    f = visual.features(page, 3)
    assert len(f) == 24 and f[0] == 3 and f[1] == 0.75 and abs(f[2] - 0.5) < 0.01 and abs(f[6] - 1) < 0.02
    assert visual.features(None, 0) == [0.0] * 24
    with pytest.raises(ValueError, match="two classes"):
        visual.train(spark.createDataFrame([("a", [0.0] * 24)], "label string, features array<double>"))


def test_layout_lines(spark):
    items = [("Address:", 1.0, None, [10.0, 700.0, 60.0, 710.0]), ("12 Oak", 1.0, None, [70.0, 702.0, 99.0, 711.0]), ("top", 1.0, None, [0.0, 5.0, 9.0, 9.0]), (None, 1.0, None, None)]
    cols = "id int, ocr_pages array<struct<page_index:int,image_width:int,image_height:int,page_width:double,page_height:double,dpi:double,items:array<struct<text:string,score:double,polygon:array<array<double>>,bbox:array<double>>>>>"
    docs = spark.createDataFrame([(1, [(0, 500, 1000, 1.0, 1.0, 72.0, items)]), (2, None), (3, [])], cols)
    assert {x.id: x.lines for x in layout.layout_lines(docs, parity=False).collect()} == {1: ["Address 12 Oak"], 2: [], 3: []}
    assert layout.layout_lines(docs, parity=True).where("id = 1").first().lines == []


def test_tokens_both_shapes():
    assert scan.tokens([[[[0, 0], [4, 0], [4, 2], [0, 2]], (" a ", 0.9)], ["bad"], [[[0, 0]], ("", 1)]]) == [{"text": "a", "score": 0.9, "polygon": [[0, 0], [4, 0], [4, 2], [0, 2]], "bbox": [0, 0, 4, 2]}]
    assert scan.tokens({"rec_texts": ["a", ""], "rec_scores": [0.5], "rec_boxes": [[1, 2, 3, 4], [0, 0, 1, 1]]})[0]["bbox"] == [1, 2, 3, 4]


def test_store_and_filing(spark, tmp_path):
    s = store.VersionedStore(spark, str(tmp_path / "s"))
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "doc_id string, v string")
    s.append(a)
    s.append(a)
    assert s.read().count() == 2
    s.upsert(spark.createDataFrame([("2", "z")], "doc_id string, v string"))
    assert {(x.doc_id, x.v) for x in s.read().collect()} == {("1", "x"), ("2", "z")}
    with pytest.raises(KeyError):
        s.upsert(spark.createDataFrame([("9", "z")], "doc_id string, v string"))
    s.remove(spark.createDataFrame([("1",)], "doc_id string"))
    assert s.read().count() == 1
    with pytest.raises(ValueError, match="output folder"):
        s.settings(output_folder=" ")
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    plan = spark.createDataFrame([("1", str(tmp_path / "a.pdf"), "F/a.pdf", "copy", "text"), ("2", str(tmp_path / "none.pdf"), "F/b.pdf", "copy", "")], "doc_id string, source_path string, dest string, mode string, ocr_text string")
    for _ in range(2):
        done = {x.doc_id: x for x in store.execute_filing(plan, str(tmp_path / "out")).collect()}
    assert done["1"].error == "" and "FileNotFoundError" in done["2"].error
    assert (tmp_path / "out/F/a.txt").read_text() == "text" and (tmp_path / "a.pdf").exists()


def test_filing_overwrites_nothing(spark, tmp_path):
    out = tmp_path / "out"
    (out / "F").mkdir(parents=True)
    (out / "F/a.pdf").write_bytes(b"other")
    for n in ("1", "2"):
        (tmp_path / f"{n}.pdf").write_bytes(n.encode())
    cols = "doc_id string, source_path string, dest string, mode string"
    plan = spark.createDataFrame([(n, str(tmp_path / f"{n}.pdf"), "F/a.pdf", "move") for n in ("1", "2")], cols).coalesce(1)

    def writer(path, row):
        with open(path, "ab") as f:
            f.write(b" meta")

    first = {x.doc_id: x.filed_path for x in store.execute_filing(plan, str(out), writer).collect()}
    again = {x.doc_id: (x.filed_path, x.error) for x in store.execute_filing(plan, str(out), writer).collect()}
    assert again == {k: (v, "") for k, v in first.items()} and sorted(p.name for p in (out / "F").iterdir()) == ["a (2).pdf", "a (3).pdf", "a.pdf"]
    assert (out / "F/a.pdf").read_bytes() == b"other" and (out / "F/a (2).pdf").read_bytes() == b"1 meta"
    assert not (tmp_path / "1.pdf").exists() and {x.dest for x in store.taken_names(spark, str(out)).collect()} == {"F/a.pdf", "F/a (2).pdf", "F/a (3).pdf"}


def test_filing_jobs(spark, tmp_path):
    cols = "doc_id string, scan_id long, packet_id long, ordinal int, source_path string, source_name string, is_lookup boolean, status string, lot string, address string, document_type string, project_code string, section string, tax_map string, parcel string, tax_id string, folder_name string, file_name string, ocr_text string"
    kinds = ["Site Plan", "Wall Check", "Lookup Only", "Site Plan"]
    for i in range(3):
        (tmp_path / f"{i}.pdf").write_bytes(b"x")
    rows = [(str(i), i, i // 3, i, str(tmp_path / f"{i}.pdf"), f"{i}.pdf", k == "Lookup Only", "ready", str(5 + i), "1 A St", k, "P", "", "", "", "", "", f"{k}.pdf", "words") for i, k in enumerate(kinds)]
    queue = store.VersionedStore(spark, str(tmp_path / "queue"))
    queue.append(spark.createDataFrame(rows, cols), 0)
    single = store.file_documents(queue, str(tmp_path / "out"), copy=True, only=spark.createDataFrame([("1",)], "doc_id string")).collect()
    assert [(x.doc_id, x.error) for x in single] == [("1", "")] and {x.doc_id for x in queue.read().collect()} == {"0", "2", "3"}
    done = {x.doc_id: x for x in store.file_documents(queue, str(tmp_path / "out"), save_text=True).collect()}
    assert done["0"].error == "" and "FileNotFoundError" in done["3"].error
    assert [x.doc_id for x in queue.read().collect()] == ["3"]  # what failed stays
    assert not (tmp_path / "2.pdf").exists() and not (tmp_path / "0.pdf").exists() and (tmp_path / "1.pdf").exists()
    assert [(x.lot_number, x.file_count) for x in store.read_audit(spark, str(tmp_path / "out/filing_audit")).collect()] == [("5", 1)]
    with pytest.raises(ValueError, match="no permanent"):
        store.file_documents(queue, str(tmp_path / "out"), only=spark.createDataFrame([("9",)], "doc_id string"))


def test_store_appends_parts_and_knows_batches(spark, tmp_path):
    s = store.VersionedStore(spark, str(tmp_path / "s"), compact_after=3)
    for batch in (0, 1, 1, 2, 3, 4):
        s.append(spark.createDataFrame([(str(batch), "a"), ("0", "again")], "doc_id string, v string"), batch)
    assert {x.doc_id: x.v for x in s.read().collect()} == {"0": s.read().where("doc_id = '0'").first().v} | {str(i): "a" for i in range(1, 5)}
    assert len(s._pointer()["parts"]) <= 3 and s.read().count() == 5


def test_names_beyond_the_last_number_raise(spark, monkeypatch):
    monkeypatch.setattr(review, "MOST_CLAIMS", 2)
    plan = spark.createDataFrame([(1, i, i, "A", "x.pdf") for i in range(3)], "packet_id int, ordinal int, scan_id int, folder_name string, file_name string")
    with pytest.raises(Exception, match="no free name"):
        review.unique_paths(plan).collect()


def test_ranks_of_a_hot_group(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot"] * 9 + ["a", "b", None]), r.randrange(50), i) for i in range(900)]
    got = {x.i: x.at for x in review.ranked(spark.createDataFrame(rows, "k string, o int, i int"), ["k"], ["o", "i"], "at").collect()}
    want = {}
    for k in {x[0] for x in rows}:
        want |= {i: n for n, (_, i) in enumerate(sorted((o, i) for q, o, i in rows if q == k), 1)}
    assert got == want


def _fetch(columns, predicates, limit):
    rows = [{c: "x" for c in columns} | {columns[0]: f"Velden {i}", columns[1]: str(i % 2)} for i in range(6)]
    return [r for r in rows if all(r[k] == v for k, v in predicates.items())][:limit]


def test_register_source_pushes_equality(spark):
    f = list(register.FIELDS.values())
    reader = scan.RegisterReader(scan.RegisterSource({}).schema(), {"fetch": f"{__name__}:_fetch"})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.read(reader.partitions()[0])) == []
    left = list(reader.pushFilters([EqualTo((f[1],), "1"), EqualTo((f[1],), "0"), EqualTo((f[1],), "1")]))
    assert left == [EqualTo((f[1],), "0")] and reader.predicates == {f[1]: "1"}
    assert [r[0] for r in reader.read(reader.partitions()[0])] == ["Velden 1", "Velden 3", "Velden 5"]


def test_edits_ask_the_register(spark, reg):
    import datetime as dt

    day = lambda n: dt.datetime(2026, 1, n)
    fields = ["address", "lot", "tax_map", "parcel", "tax_id", "section", "project_code"]
    rows = [(1, 7, 1, 1, "Site Plan", False), (2, 7, 2, 2, "Wall Check", False), (3, 7, 3, 3, "Lookup Only", True), (4, 8, 1, 4, "Site Plan", False)]
    docs = spark.createDataFrame(rows, "record_id long, packet_id long, ordinal int, scan_id long, document_type string, is_lookup boolean").withColumns({f: F.lit("") for f in [*fields, "source_name"]})
    cols = "update_id long, record_id long, packet_id long, changed_field string, tax_id string, address string, lot string, document_type string, auto_folder boolean, folder_name string, file_name string, updated_at timestamp"
    edits = [
        (1, 2, 7, "tax_id", "05-123456", None, None, None, True, None, None, day(1)), (2, 1, 7, "lot", None, None, "99", None, False, "My folder", "typed.name.pdf", day(2)),
        (3, 4, 8, "address", None, "44 Oak Ln", None, None, True, "ignored", None, day(1)),
    ]
    updates = spark.createDataFrame(edits, cols).withColumns({f: F.lit(None).cast("string") for f in ("project_code", "tax_map", "parcel", "section")}).withColumn("auto_file_name", F.lit(False))
    got = {x.record_id: x for x in review.apply_updates(docs, updates, "batch", known=reg, county="A").collect()}
    assert got[1].address == got[2].address == "00012 MAIN ST MD" and got[3].address == ""  # the packet's first document is asked for, print-outs stay
    assert got[1].lot == got[2].lot == "99" and got[1].tax_map == "0012"  # edited after the lookup
    assert got[1].folder_name == "My folder" and got[1].file_name == "typed.name.pdf" and got[2].folder_name == "Lot 99 - 00012 MAIN ST MD"
    assert got[4].tax_id == "" and got[4].address == "44 Oak Ln"  # no such place in the county
    alone = {x.record_id: x for x in review.apply_updates(docs, updates, "mass", known=reg).collect()}
    assert alone[1].address == "" and alone[2].tax_id == "05-123456" and alone[2].address == "00012 MAIN ST MD" and alone[4].tax_id == "06-00123456"


def test_packet_refresh_takes_the_first_document(spark, reg):
    cols = "doc_id long, packet_id long, ordinal int, scan_id long, is_lookup boolean, lot string, address string, tax_map string, parcel string, tax_id string, section string"
    docs = spark.createDataFrame([(1, 1, 1, 1, True, "", "", "", "", "06-00123456", ""), (2, 1, 2, 2, False, "a", "b", "", "", "05-123457", "s"), (3, 1, 3, 3, False, "", "", "", "", "06-00123456", "")], cols)
    got = {x.doc_id: x for x in register.refresh_packets(docs, reg, "tax_id", "A").collect()}
    assert got[2].tax_id == got[3].tax_id == "05-123457" and got[3].lot == "8" and got[3].section == "s" and got[1].lot == ""
    by_map = {x.doc_id: x for x in register.refresh(docs.withColumn("parcel", F.lit("36")), reg, "parcel", "B").collect()}
    assert by_map[3].lot == "9" and by_map[1].lot == ""


def test_issue_messages_of_every_form(spark):
    values = [None, " ", "one", '["a", {"message": "b"}, {"error": "c"}, " "]', '{"detail": "d"}', '{"x": 1}', "[not a list"]
    got = [x.m for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(review.messages(F.col("v")).alias("m")).collect()]
    assert got == [[], [], ["one"], ["a", "b", "c"], ["d"], [], ["[not a list"]]


def test_model_labels_saved_and_cached(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, "field_notes" if i % 2 else "not_field_notes", [float(i % 2) + r.random() for _ in range(12)] + [r.random() for _ in range(12)]) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id int, label string, features array<double>")
    model, report = visual.train(frame, trees=20, path=str(tmp_path / "m"))
    assert report["held_out"] and set(report["per_class"]) == {"field_notes", "not_field_notes"} and report["accuracy"] > 0.8
    loaded = visual.cached_model(str(tmp_path / "m"))
    assert loaded is visual.cached_model(str(tmp_path / "m"))
    out = visual.classify(frame, model=loaded).collect()
    assert sum(x.visual_label == x.label for x in out) > 70 and all(0.5 <= x.confidence <= 1 for x in out)


def test_folder_gives_section_and_project():
    from cadastrix.plans.config import ScanSettings, folder_names, named_run

    assert [folder_names(p) for p in ("/x/ab12", "/x/ab12.3 - east", "/x/ab12.3/", "")] == [("ab12", ""), ("ab12", "3"), ("ab12", "3"), ("", "")]
    run = named_run(ScanSettings(output_folder="/x/ab12.3-east"))
    assert (run.project_code, run.section) == ("AB12", "3")
    assert named_run(ScanSettings(output_folder="/x/ab12", project_code="own")).project_code == "OWN"
    assert scan.workers(4, "gpu:0") == 1 and scan.workers(0, "cpu") == 1
    first = scan.cached_engine("a", lambda: object())
    assert scan.cached_engine("a", lambda: object()) is first


def test_windows_equal_plain_search_over_many_phrases():
    config = load_config()
    r = random.Random(11)
    for _ in range(40):
        words = [r.choice(["wall chegk", "slte plxn", "house locetlon", "the north", "plat", "of lot", "pler plen"]) for _ in range(r.randrange(1, 6))]
        body = " ".join("".join(c if r.random() > 0.1 else r.choice("abcdefghi ") for c in w) for w in words)
        got = extract.similar_type(extract.fold(body), config.keywords())
        best = ("Field Notes", 0.0)
        want = brute_type(body, config)
        assert (got[0] if got else best[0]) == want


def test_scan_folder_and_stream(spark, tmp_path):
    for n in ("b.PDF", "a.pdf", "note.txt"):
        (tmp_path / n).write_bytes(b"LOT 5")
    files = scan.scan_folder(spark, str(tmp_path))
    assert [(x.ordinal, x.source_name) for x in files.orderBy("ordinal").collect()] == [(0, "a.pdf"), (1, "b.PDF")]
    engine = lambda: lambda content, dpi: [{"page_index": 0, "image_width": 1, "image_height": 1, "page_width": 1.0, "page_height": 1.0, "dpi": float(dpi), "items": [{"text": content.decode(), "score": 1.0, "polygon": None, "bbox": None}]}]
    assert {x.ocr_text for x in scan.recognise(files, engine).collect()} == {"LOT 5"}


def test_updates_order_and_repeats(spark):
    docs = spark.createDataFrame([(1, 7, "a", "x"), (2, 7, "b", None)], "record_id long, packet_id long, lot string, document_type string").withColumns({c: F.lit("") for c in ("address", "project_code", "tax_map", "parcel", "tax_id", "section", "source_name")})
    cols = "update_id long, record_id long, packet_id long, lot string, address string, project_code string, document_type string, tax_map string, parcel string, tax_id string, section string, updated_at timestamp"
    rows = [(2, 1, 7, "late", None, None, "T", None, None, None, None, 2), (1, 1, 7, "early", None, None, None, None, None, None, None, 1), (2, 1, 7, "late", None, None, "T", None, None, None, None, 2)]
    import datetime as dt

    updates = spark.createDataFrame([(*r[:-1], dt.datetime(2026, 1, r[-1])) for r in rows], cols)
    both = {x.record_id: x for x in review.apply_updates(docs, updates, "batch").collect()}
    assert both[1].lot == both[2].lot == "late" and both[1].document_type == "T" and both[2].document_type == "" and both[2].updates == 2
    alone = {x.record_id: x for x in review.apply_updates(docs, updates, "mass").collect()}
    assert alone[2].lot == "b"


def test_progress(spark):
    p = mass.Progress()
    p.add(" ")
    p.add("x")
    with p.timed("s"):
        pass
    snap = p.snapshot()
    p.add("y")
    assert len(snap["messages"]) == 1 and "s" in snap["timings"]
    ranked = review.stage_ranking(spark.createDataFrame([("r", "a", 1.0), ("r", "b", 3.0)], "run_id string, stage string, seconds double")).orderBy("rank").collect()
    assert [(x.stage, x.pct) for x in ranked] == [("b", 75.0), ("a", 25.0)]


def test_parity_flag():
    assert Config().parity and not Config(parity=False).parity


ADDRESSES = ["", "12 Hill St", "44 Pine Ln"]


def whole_docs(spark):
    """Documents whose type is misread and whose address stands only in the layout, with pages, and features of field notes."""

    def page(address):
        corners = lambda x, y: [[x, y], [x + 50.0, y], [x + 50.0, y + 10.0], [x, y + 10.0]]
        words = [(w, 1.0, corners(10.0 + 60 * i, 900.0), None) for i, w in enumerate(address.split())]
        return [(0, 500, 1000, 1.0, 1.0, 72.0, [*words, ("9 Elm St", 1.0, corners(10.0, 100.0), None)])]

    texts = ["W4LL CHEGK 12", "S1TE PLXN\nLOT 3", "h0use locetion", "nothing known", None, "WALL CHEGK"]
    notes = [3.0, 0.75, 0.1, 0.0, 0.05, 0.01] + [0.0] * 18
    rows = [(i, 1, i, f"{i}.pdf", t, page(ADDRESSES[i % 3]) if i < 4 else None, notes if i in (0, 5) else [1.0] + [0.0] * 23) for i, t in enumerate(texts)]
    return texts, spark.createDataFrame(rows, DOCS + f", ocr_pages array<struct<{scan.PAGE.replace(' int', ':int').replace(' double', ':double').replace(' array', ':array')}>>, features array<double>")


def brute_type(text, config):
    body = extract.fold(text or "")
    best = ("Field Notes", 0.0)
    for label, phrases in config.keywords():
        for phrase in map(extract.fold, phrases):
            for n in range(max(3, len(phrase) - 3), min(len(body), len(phrase) + 4) + 1):
                for at in range(len(body) - n + 1):
                    score = SequenceMatcher(None, phrase, body[at : at + n], autojunk=False).ratio()
                    if score >= 0.75 and score > best[1]:
                        best = (label, score)
    return best[0]


def test_whole_jobs_equal_brute_force(spark, reg):
    texts, docs = whole_docs(spark)
    config = load_config(county="A")
    kinds = {i: brute_type(t, config) for i, t in enumerate(texts)}
    assert kinds[0] == "Wall Check" and kinds[1] == "Site Plan" and kinds[2] == "House Location"
    places = {i: (ADDRESSES[i % 3] if i < 4 else "") or "Unknown Address" for i in range(6)}
    alone = {x.scan_id: x for x in mass.process(docs, reg, config, key="scan_id").collect()}
    assert {i: x.document_type for i, x in alone.items()} == kinds
    assert {i: x.address for i, x in alone.items()} == places
    got = {x.scan_id: x for x in batch.run(docs, reg, config).collect()}
    # of two wall checks that look like field notes the later one becomes such (M-10), the other stays
    assert {i: x.document_type for i, x in got.items()} == kinds | {5: "Field Notes"}
    assert got[0].address == got[5].address == "12 Hill St"  # first of the packet's two addresses
    off = {x.scan_id: x.document_type for x in batch.run(docs, reg, config.with_rules(visual_field_notes_classifier=False)).collect()}
    assert off == kinds


def test_whole_queries_are_registered(spark):
    from cadastrix.plans import queries

    whole = {"q55_extract_whole", "q56_batch_whole", "q57_mass_whole", "q58_mass_stream_whole"}
    assert whole <= set(queries.queries()) and not whole & set(queries.oracle_sql())


def _most_rows(df):
    """The largest number of rows that any step of the plan that ran put out."""
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        left += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
    return most


def test_refresh_by_map_lists_no_pairs(spark, reg):
    rows = reg.where("register_id = 1").crossJoin(spark.range(150).withColumnRenamed("id", "_i")).withColumns({"register_id": F.col("_i") + 1, "lot": F.col("_i").cast("string")}).drop("_i")
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(False).alias("is_lookup"), F.col("id").cast("string").alias("lot"), F.lit("12").alias("tax_map"), F.lit("34").alias("parcel"), *(F.lit("").alias(c) for c in ("address", "tax_id", "section")))
    got = register.refresh(docs, rows, "tax_map", "A")
    assert _most_rows(got) <= 2 * 150 * 16
    assert {x.doc_id: x.lot for x in got.collect()} == {i: str(i if i < 150 else 0) for i in range(200)}


def test_first_records_equal_the_ranked_lookup(spark, reg):
    luck = random.Random(5)
    some = lambda values: luck.choice(values)
    base = reg.where("register_id = 1").drop("register_id", "county", "account_id", "district", "account_number", "lot", "map", "parcel")
    known = [(i, some("AB"), some(["", "x", "y"]), some(["05", "5", ""]), some(["123456", "123457", "", "000007"]), some(["1", "01", "2", ""]), some(["12", "0012", "012", "000", "0", ""]), some(["34", "0034", "A1", ""])) for i in range(120)]
    register_rows = spark.createDataFrame(known, "register_id long, county string, account_id string, district string, account_number string, lot string, map string, parcel string").crossJoin(base)
    asked = [(i, (some(["", "1", "001", "9", "-"]), some(["", "12", "0012", "000", "77"]), some(["", "34", "a-1", "99"]), some(["", "", "5"]), some(["", "", "123456", "7"]))) for i in range(400)]
    probes = spark.createDataFrame(asked, "probe long, terms struct<lot:string,tax_map:string,parcel:string,district:string,account_number:string>")
    for county, limit in (("a", 200), ("a", 3), ("", 200)):
        want = register.lookup(probes, register_rows, county, limit).where("rank = 1").select("probe", register.register_values().alias("record"))
        got = register.first_records(probes, register_rows, county, limit)
        assert {x.probe: x.record for x in got.collect()} == {x.probe: x.record for x in want.collect()} and got.count() == want.count()


def test_stream_works_on_new_documents_only(spark, reg, tmp_path):
    docs = spark.createDataFrame([(i, 1, i, f"{i}.pdf", f"SITE PLAN\nLOT {i}") for i in range(3)], DOCS).withColumn("doc_id", F.col("scan_id"))
    held = store.VersionedStore(spark, str(tmp_path / "held"), key="scan_id")
    seen = []
    for number, part in enumerate((docs.where("scan_id < 2"), docs)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        publish = lambda batch, n: (seen.append(sorted(x.scan_id for x in batch.collect())), mass.publish_to(held)(batch, n))
        mass.start(source, reg, load_config(county="A"), publish, str(tmp_path / "state"), fuzzy=False, store=held).awaitTermination()
    assert seen == [[0, 1], [2]] and {x.scan_id: x.lot for x in held.read().collect()} == {0: "0", 1: "1", 2: "2"}


def test_arrivals_follow_the_size(spark, tmp_path):
    from cadastrix.plans import queries

    spark.range(1).write.parquet(str(tmp_path / "small"))
    spark.range(0, 1 << 20, 1, 1).select(F.xxhash64("id").alias("a")).write.parquet(str(tmp_path / "large"))
    assert [queries.arrival_files(spark, spark.read.parquet(str(tmp_path / n))) for n in ("small", "large")] == [1, 4]
