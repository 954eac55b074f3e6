"""Every rule: a baseline that must pass, then one corruption that it must catch."""

import dataclasses
import hashlib

import pytest
from pyspark.sql import functions as F

from veriledger import session
from veriledger.operators import ownership, validation
from veriledger.plans import q_validation
from veriledger.sources import registry

URL = "https://example.org/a{}"
SOURCE = "host:example.org"


def rows():
    """A valid 22-cell ledger of one subject, as plain rows."""
    method = {4: "http_range", 6: "repo_tree_probe", 12: "hf_probe.weight_object", 13: "hf_probe.all_shard_digests", 16: "reproduction_search", 17: "reproduction_search"}
    cells, evidence, policy = [], [], []
    for axis in registry.AXIS_IDS:
        m = method.get(axis, "grep_retrieved")
        fields = {f: "x" for f in registry.REQUIRED_FIELDS.get(m, [])} | {"expect_file": "f", "expect_evidence_sha256": "d"}
        cells.append(dict(cell_no=axis, subject="s", axis=axis, score=1, na_reason=None, note="", has_check=True, check_method=m,
                          check_asserts="a", check_observed="b", check_expect=["literal"], check_fields=fields, has_bound=False,
                          bound_method=None, bound_asserts=None, bound_observed=None, bound_as_of=None, bound_archived=None,
                          bound_live=None, bound_legacy=None, bound_fields=None))
        evidence.append(dict(cell_no=axis, subject="s", axis=axis, pos=0, url=URL.format(axis), retrieved="2026-01-01",
                             sha256=f"{axis:064x}", volatile=None, volatile_reason=None))
        for key, value in [("axis_sources", SOURCE), ("axis_documents", URL.format(axis)), ("axis_method", m), ("axis_literals", "literal")]:
            policy.append(("s", axis, key, value))
    return dict(cells=cells, evidence=evidence, policy=policy, subjects=[("s", "open-weights", "o/r")], sources=[("s", SOURCE)],
                warrants=[], superseded=[], records=[("s", '{"id": "s", "kind": "x"}')])


CELL = ("cell_no long, subject string, axis int, score int, na_reason string, note string, has_check boolean, check_method string, "
        "check_asserts string, check_observed string, check_expect array<string>, check_fields map<string,string>, has_bound boolean, "
        "bound_method string, bound_asserts string, bound_observed string, bound_as_of string, bound_archived array<string>, "
        "bound_live array<string>, bound_legacy boolean, bound_fields map<string,string>")
EVIDENCE = "cell_no long, subject string, axis int, pos int, url string, retrieved string, sha256 string, volatile boolean, volatile_reason string"


def build(spark, r):
    def frame(name, schema):
        return spark.createDataFrame([tuple(x.values()) if isinstance(x, dict) else x for x in r[name]], schema)

    evidence = frame("evidence", EVIDENCE)
    return validation.Ledger(
        subjects=frame("subjects", "subject string, kind string, repo string"), cells=frame("cells", CELL), evidence=evidence,
        sources=frame("sources", "subject string, source string"), policy=frame("policy", "subject string, axis int, key string, value string"),
        warrants=frame("warrants", "subject string, source string, document string"),
        superseded=frame("superseded", "subject string, address string, grp int, superseded_by string, still_valid_for array<int>"),
        records=frame("records", "subject string, record string"),
        cited=evidence.select(F.lit("l").alias("label"), "url", "sha256"), as_of="2026-06-01", bounded_zero_floor=r.get("floor", 0),
    )


def corrupt(**changes):
    """Change fields of the axis-1 cell."""
    def apply(r):
        r["cells"][0].update(changes)
    return apply


def bound(**changes):
    def apply(r):
        r["cells"][0].update({**dict(score=0, has_check=False, has_bound=True, bound_method="grep_retrieved", bound_asserts="a", bound_observed="b",
                                     bound_as_of="2026-01-01", bound_archived=[URL.format(1)], bound_live=[], bound_legacy=False,
                                     bound_fields={"expect": "x"}), **changes})
    return apply


def evid(**changes):
    def apply(r):
        r["evidence"][0].update(changes)
    return apply


def two(r, **changes):
    r["cells"][0].update({"score": 2, **changes})


CASES = [
    ("V1", lambda r: r["policy"].append(("s", 1, "axis_sources", "host:other"))),
    ("V2", lambda r: r["superseded"].append(("s", "host:nowhere", 1, "x", []))),
    ("V3", lambda r: r["superseded"].append(("s", SOURCE, 1, "x", [2, 3, 4, 5]))),
    ("V4", bound(bound_as_of="last week")),
    ("V4", corrupt(check_fields={"expect": "given", "as_of": "soon"})),
    ("V5", lambda r: r["subjects"].append(("s", "open-weights", "o/r"))),
    ("V6", corrupt(axis=99)),
    ("V7", corrupt(subject="ghost")),
    ("V8", lambda r: r["cells"].append({**r["cells"][0], "cell_no": 99})),
    ("V9", corrupt(score=3)),
    ("V10", corrupt(score=None, na_reason="because")),
    ("V11", lambda r: r["cells"][11].update(score=None, na_reason=" ")),
    ("V11", lambda r: r["cells"][11].update(score=None, na_reason="\t\n")),
    ("V12", lambda r: r["evidence"].pop(0)),
    ("V13", evid(url="ftp://example.org/a1")),
    ("V14", evid(retrieved="2026-99-99")),
    ("V14", evid(retrieved="2027-01-01")),
    ("V15", lambda r: (two(r, check_method="http_status"), evid(volatile=True, volatile_reason="x")(r))),
    ("V16", evid(volatile=True)),
    ("V17", evid(sha256="A" * 64)),
    ("V18", lambda r: r["cells"][4].update(score=2)),
    ("V19", lambda r: (two(r), evid(url="https://example.org/main/a1")(r))),
    ("V20", lambda r: two(r, has_check=False)),
    ("V21", corrupt(check_method="read_document")),
    ("V22", corrupt(check_method="http_range")),
    ("V23", lambda r: r["cells"][5].update(score=2, check_method="grep_retrieved")),
    ("V24", corrupt(check_fields={"expect": "[]"})),
    ("V25", corrupt(check_expect=[])),
    ("V26", corrupt(check_asserts=" ")),
    ("V27", bound(score=1)),
    ("V27", bound(bound_as_of="")),
    ("V28", bound(bound_archived=[])),
    ("V28", bound(bound_archived=["https://example.org/none"])),
    ("V28", bound(bound_live=[URL.format(1)])),
    ("V28", bound(bound_legacy=True)),
    ("V29", lambda r: r["evidence"][1].update(url=URL.format(1))),
    ("V30", lambda r: r["evidence"][1].update(sha256=f"{1:064x}")),
    ("V31", lambda r: r["sources"].clear()),
    ("V32", evid(url="https://other.org/a1")),
    ("V33", lambda r: r["cells"].pop(0)),
    ("V34", lambda r: r.update(floor=1)),
    ("V37", lambda r: r.update(subjects=[("s", "api-only", "o/r")])),
    ("V39", lambda r: r.update(records=[("s", '{"id": 1, "colour": 2}')])),
    ("V40", lambda r: r["evidence"].append({**r["evidence"][0], "pos": 1, "volatile": False})),
]


@pytest.fixture(scope="module")
def clean(spark):
    return build(spark, rows())


def test_baseline_passes(clean):
    assert validation.scoreable(validation.validate(clean))
    assert ownership.foreign_evidence(clean).isEmpty()
    assert {r.verdict for r in ownership.gate(clean).collect()} == {"pass"}


@pytest.mark.parametrize("rule, change", CASES, ids=[f"{i}-{c[0]}" for i, c in enumerate(CASES)])
def test_rule_fires(spark, rule, change):
    r = rows()
    change(r)
    assert not validation.RULES[rule](build(spark, r)).isEmpty()


def test_valid_bound_passes(spark):
    r = rows()
    bound()(r)
    led = build(spark, r)
    assert all(validation.RULES[x](led).isEmpty() for x in ("V4", "V24", "V27", "V28"))


OWNERSHIP = [
    ("O1", lambda r: r["sources"].clear()),
    ("O2", lambda r: r["policy"].remove(("s", 1, "axis_sources", SOURCE))),
    ("O3", lambda r: r["evidence"][0].update(url="https://other.org/a1")),
    ("O4", lambda r: r["evidence"].append({**r["evidence"][0], "url": "https://example.org/extra"})),
    ("O5", lambda r: r["policy"].remove(("s", 1, "axis_method", "grep_retrieved"))),
    ("O6", corrupt(check_method="count_in_retrieved")),
    ("O7", lambda r: r["policy"].append(("s", 1, "axis_evidence_sha256", "other"))),
    ("O8", lambda r: r["policy"].append(("s", 1, "axis_file", "other"))),
    ("O9", corrupt(check_expect=["literal", "another"])),
]


@pytest.mark.parametrize("rule, change", OWNERSHIP, ids=[o[0] for o in OWNERSHIP])
def test_ownership_fires(spark, rule, change):
    r = rows()
    change(r)
    led = build(spark, r)
    assert not ownership.ownership_rule(led, rule).isEmpty()
    failed = [x for x in ownership.gate(led).collect() if x.verdict == "fail"]
    assert failed and all(x.reason == "ownership" for x in failed)


def test_third_party_search_is_exempt_from_source_rule(spark):
    r = rows()
    r["evidence"][15].update(url="https://elsewhere.org/q")  # axis 16 is settled by a search
    assert ownership.ownership_rule(build(spark, r), "O3").isEmpty()


def test_user_rule_registration(spark, clean):
    validation.register_rule("X1", lambda led: validation.violations(led.cells.filter("score = 1"), "X1", "subject", "axis", None))
    try:
        assert validation.validate(clean).filter("rule = 'X1'").count() == 22
    finally:
        validation.RULES.pop("X1")


def details(led, rule):
    return sorted(r.detail for r in validation.RULES[rule](led).collect())


def test_every_value_of_a_broken_dependency_is_reported(spark):
    r = rows()
    for i in (1, 2):
        r["evidence"].append({**r["evidence"][0], "pos": i, "sha256": f"{90 + i:064x}", "volatile": i == 1})
    led = build(spark, r)
    assert details(led, "V29") == sorted(f"{URL.format(1)} {n:064x}" for n in (1, 91, 92))
    assert details(led, "V40") == sorted(f"{URL.format(1)} {f}" for f in ("None", "true", "false"))


def test_every_later_duplicate_and_every_owner(spark):
    r = rows()
    r["cells"] += [{**r["cells"][0], "cell_no": n} for n in (98, 99)]
    r["sources"] += [("t", "host:other.org"), ("u", "host:other.org")]
    r["evidence"][0]["url"] = "https://other.org/a1"
    led = build(spark, r)
    assert details(led, "V8") == ["98 after 1", "99 after 98"]
    assert details(led, "V32") == ["host:other.org of t and 1 more"]
    assert {(r.source, r.owner) for r in validation.foreign_owners(led).collect()} == {("host:other.org", "t"), ("host:other.org", "u")}


def test_empty_lists_of_the_policy(spark):
    r = rows()
    r["policy"] = [p for p in r["policy"] if p[1] != 1 or p[2] not in ("axis_sources", "axis_documents")]
    r["policy"] += [("s", 1, "axis_sources", None), ("s", 1, "axis_documents", None)]
    r["superseded"].append(("s", SOURCE, 1, "x", [2, 3, 4, 5]))
    r["evidence"].pop(0)
    led = build(spark, r)
    assert {(x.axis, x.detail) for x in validation.RULES["V3"](led).collect()} == {(1, SOURCE)}  # falls back to the subject's sources
    assert ownership.ownership_rule(led, "O4").filter("axis = 1").isEmpty()


def test_bad_ledger_date_is_a_defect(spark):
    led = dataclasses.replace(build(spark, rows()), as_of="first of June")
    found = validation.validate(led)
    assert ("V4", "first of June") in {(x.rule, x.detail) for x in found.collect()} and not validation.scoreable(found)


def test_ownership_is_part_of_validation(spark):
    r = rows()
    r["policy"].remove(("s", 1, "axis_method", "grep_retrieved"))
    assert {x.rule for x in validation.validate(build(spark, r)).collect()} == {"O5"}


def test_dates_of_the_ledger_and_of_the_cell_block(spark):
    def found(led):
        return sorted(x.detail for x in validation.ledger_date(led).unionByName(validation.RULES["V4"](led)).collect())

    plain = build(spark, rows())
    assert found(dataclasses.replace(plain, as_of="")) == [] and found(dataclasses.replace(plain, as_of="2024-13-45")) == []
    mixed = rows()
    bound(bound_as_of="2026-01-01")(mixed)  # a cell with a bound is judged by the bound's date
    for cell in mixed["cells"]:
        if cell["has_bound"]:
            cell["check_fields"] = {"as_of": "soon"}
    assert found(build(spark, mixed)) == []


def test_every_use_beside_every_owner(spark, monkeypatch):
    monkeypatch.setattr(validation, "DEAL", 1)
    r = rows()
    r["sources"] += [("t", "host:other.org"), ("u", "host:other.org"), ("u", "host:other.org")]
    for i in range(3):
        r["evidence"][i]["url"] = "https://other.org/a1"
    r["evidence"][3]["url"] = "https://nobody.org/a1"
    r["evidence"][4]["url"] = None
    found = validation.foreign_uses(build(spark, r)).collect()
    axes = [e["axis"] for e in r["evidence"][:5]]
    want = [(a, f"host:other.org of {o}") for a in axes[:3] for o in "tu"] + [(axes[3], "host:nobody.org"), (axes[4], None)]
    assert sorted(((x.axis, x.detail) for x in found), key=str) == sorted(want, key=str)


def test_a_kept_ledger_reads_the_given_rows_once(spark, tmp_path):
    def given(name, schema, found):
        spark.createDataFrame(found, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    given("supplier", "s_suppkey long", [(i,) for i in range(1, 12)])
    given("lineitem", "l_suppkey long, l_partkey long, l_returnflag string", [(1 + i % 11, i * 7 % 97, "RNA"[i % 3]) for i in range(900)])
    given("pages", "page_id long, url string, html string", [(i, f"https://h{i % 5}.example/{i}", f"page {i % 40}") for i in range(50)])
    plain, kept = (q_validation.ledger(spark, str(tmp_path), keep) for keep in (False, True))
    for name in plain.VIEWS:
        rows_of = [sorted(map(repr, getattr(led, name).collect())) for led in (plain, kept)]
        assert rows_of[0] == rows_of[1] != [], name
        assert all("/staged-" in f for f in getattr(kept, name).inputFiles()), name
    floor = [spark.range(1).select(led.bounded_zero_floor.alias("n")).first().n for led in (plain, kept)]
    assert floor[0] == floor[1] > 1


def test_a_checkpoint_is_computed_when_it_is_made(monkeypatch):
    class Rows:
        def __init__(self, folder):
            self.sparkSession = self.sparkContext = self
            self.getCheckpointDir = lambda: folder

        def checkpoint(self, eager=False):
            return f"eager {eager}"

        def persist(self):
            return "persisted"

    assert [session.cut_lineage(Rows(f)) for f in ("/shared", None)] == ["eager True", "persisted"]


def test_uses_and_owners_dealt_into_tiles_keep_nulls(spark, monkeypatch):
    monkeypatch.setattr(validation, "DEAL", 2)
    monkeypatch.setattr(validation, "BLOCK", 2)
    r = rows()
    owners = [None, "t", "u", "v", "w"]
    r["sources"] += [(o, "host:other.org") for o in owners + owners] + [("t", None), ("u", "host:unused.org"), ("t", "host:third.org")]
    urls = ["https://other.org/a1"] * 5 + ["https://third.org/a1", "https://nobody.org/a1", None]
    for e, url in zip(r["evidence"], urls):
        e["url"] = url
    r["evidence"].append({**r["evidence"][0], "pos": 1})
    found = [(x.rule, x.subject, x.axis, x.detail) for x in validation.foreign_uses(build(spark, r)).collect()]
    want = [(axis, "host:other.org" + (f" of {o}" if o else "")) for axis in range(1, 6) for o in owners]
    want += [(6, "host:third.org of t"), (7, "host:nobody.org"), (8, None)]
    assert sorted(found, key=str) == sorted((("V32", "s", axis, detail) for axis, detail in want), key=str)
    r["evidence"] = r["evidence"][5:8]
    r["sources"] = [("s", SOURCE)]
    assert sorted(x.detail or "" for x in validation.foreign_uses(build(spark, r)).collect()) == ["", "host:nobody.org", "host:third.org"]


def test_uses_beside_owners_are_small_on_disk_and_spread_over_tasks(spark, tmp_path):
    n_uses, n_owners = 200, 4096
    r = rows()
    cell, cite = r["cells"][0], r["evidence"][0]
    r["cells"] = [{**cell, "cell_no": i, "subject": f"user{i}"} for i in range(n_uses)]
    r["evidence"] = [{**cite, "cell_no": i, "subject": f"user{i}", "url": "https://other.org/a1"} for i in range(n_uses)]
    r["sources"] = [(f"user{i}", SOURCE) for i in range(n_uses)] + [(hashlib.sha256(str(i).encode()).hexdigest(), "host:other.org") for i in range(n_owners)]
    validation.foreign_uses(build(spark, r)).write.parquet(str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert (found.count(), found.distinct().count()) == (n_uses * n_owners,) * 2
    sizes = [f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")]
    assert len(sizes) > 2 and sum(sizes) < n_uses * n_owners  # less than a byte a row, where a whole list of owners for each use takes several
