"""Hand fixtures with exact values, and brute-force checks on small tables."""

import json
import random
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake import schema
from incidentlake.functions import classify as C
from incidentlake.functions import timecols as T
from incidentlake.functions.numbers import round2
from incidentlake.operators import metrics as M
from incidentlake.operators import quality as Q
from incidentlake.operators import regionhour as R
from incidentlake.operators import scoring, skew, stats, vulnmap
from incidentlake.operators.intensity import attack_intensity
from incidentlake.sources import delimited, tables

INCIDENT_DDL = "organization_code string, region string, season string, industry string, hour int"
REQUEST_DDL = "request_id int, organization_id string, region string, season string, industry string, hour int"


def intensity(spark, incidents, requests):
    inc = spark.createDataFrame(incidents, INCIDENT_DDL)
    req = spark.createDataFrame(requests, REQUEST_DDL)
    return {r.request_id: r.attack_intensity for r in attack_intensity(req, inc).collect()}


HISTORY = [
    ("o1", "Moscow", "winter", "telecom", 9), ("o1", "Moscow", "winter", "telecom", 9),
    ("o1", "Moscow", "winter", "telecom", 10), ("o1", "Perm", "winter", "finance", 9),
]


def test_intensity_fixture(spark):
    got = intensity(spark, HISTORY, [
        (1, "o1", "Moscow", "winter", "telecom", 9),
        (2, "nobody", "MOSCOW", "winter", " Telecom ", 9),
        (3, "o1", "Atlantis", "winter", "", 9),
        (4, "o1", "Atlantis", "spring", "finance", 10),
        (5, "o1", "Moscow", "winter", "telecom", 23),
    ])
    assert got == {1: 1.33, 2: 1.33, 3: 1.5, 4: 0.5, 5: 0.0}


def test_intensity_of_an_empty_table(spark):
    assert intensity(spark, [], [(1, None, "Moscow", "winter", "telecom", 9)]) == {1: 0.0}


def brute_intensity(incidents, request):
    _, org, region, season, industry, hour = request
    scope = [i for i in incidents if not org or i[0] == org] or incidents
    for test in (
        lambda i: i[1].lower() == region.lower() and i[2] == season, lambda i: i[2] == season, lambda i: True,
    ):
        kept = [i for i in scope if test(i)]
        if kept:
            break
    if industry:
        narrow = [i for i in kept if i[3].lower() == industry.strip().lower()]
        kept = narrow if len(narrow) >= 3 else kept
    hours = [i[4] for i in kept]
    mean = len(hours) / len(set(hours)) if hours else 0.0
    return round(hours.count(hour) / max(mean, 1.0), 2)


def test_intensity_brute_force(spark):
    rng = random.Random(5)

    def pick(*items):
        return rng.choice(items)

    def skewed():
        return "o1" if rng.random() < 0.4 else f"o{rng.randrange(2, 9)}"

    incidents = [
        (skewed(), pick("A", "b", "C"), pick("winter", "spring"), pick("x", "Y", "z"), rng.randrange(6)) for _ in range(300)
    ]
    requests = [
        (i, pick("o1", "o2", "o3", "none", "", None), pick("a", "B", "q"), pick(*V.SEASONS), pick("X", " y ", "z", "", "w"), rng.randrange(8))
        for i in range(250)
    ]
    assert intensity(spark, incidents, requests) == {r[0]: brute_intensity(incidents, r) for r in requests}


def test_round2_equals_exact_binary_rounding(spark):
    rng = random.Random(1)
    values = [k / 1000 for k in range(0, 25000, 5)] + [rng.random() * 24 for _ in range(3000)] + [0.125, 0.375, 2.675]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", round2(F.col("x")).alias("r"))
    assert [r for r in df.collect() if r.r != round(r.x, 2)] == []


def test_risk_score_fixture(spark):
    rows = [(4, 2.5, "vpn_gateway"), (1, 1.0, "vpn_gateway"), (0, 0.0, "workstation")]
    df = spark.createDataFrame(rows, "known_vulnerabilities_count int, attack_intensity double, asset_type string")
    got = [(r.risk_score, r.confidence) for r in scoring.score(df).orderBy(F.desc("risk_score")).collect()]
    assert got == [(0.99, 0.95), (0.7, 0.83), (0.18, 0.62)]


def test_classifiers(spark):
    df = spark.createDataFrame(
        [("Почтовая атака", "Фишинговое письмо", "Почта"), ("SQL attack", "sql injection in web app", "СУБД"),
         ("Threat", "bios compromise", "рабочий компьютер"), (None, "nan", "")],
        "name string, description string, object_of_impact string",
    )
    got = [(r.attack_method, r.target_object) for r in C.classify_registry(df).collect()]
    assert got == [("phishing", "mail_gateway"), ("sql_injection", "db_server"), ("malware", "workstation"), ("malware", "workstation")]
    text = spark.range(1).select(C.normalized_text(F.lit("A"), F.lit(None), F.lit("nan"), F.lit("B")).alias("t")).first().t
    assert text == "a b"
    level = spark.range(1).select(C.risk_level(F.lit(1), F.lit(True), F.lit("ransomware")).alias("r")).first().r
    assert level == "critical"
    df = spark.createDataFrame([(h,) for h in (0, 6, 12, 18, 23)], "h int").select(T.time_window(F.col("h")).alias("w"))
    assert [r.w for r in df.collect()] == ["00:00-06:00", "06:00-12:00", "12:00-18:00", "18:00-24:00", "18:00-24:00"]
    assert spark.range(1).select(scoring.heuristic_method(F.lit("toaster")).alias("m")).first().m == "malware"


def test_dates(spark):
    cells = ["10.01.2026", "10.01.2026 09:00", "2026-01-10", "2026-07-20", "", "garbage", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.t for r in df.select("i", T.parse_lenient(F.col("c")).alias("t")).orderBy("i").collect()]
    assert got == [datetime(2026, 1, 10), datetime(2026, 1, 10, 9), datetime(2026, 1, 10), datetime(2026, 7, 20), None, None, None]
    df = spark.createDataFrame(
        [(datetime(2026, 1, 11), None), (None, datetime(2026, 1, 11, 21))], "incident_date timestamp_ntz, regional_time timestamp_ntz"
    )
    got = [tuple(r)[2:] for r in T.derive_time_columns(df).collect()]
    assert got == [(0, 1, "winter", "night", 7), (21, 1, "winter", "evening", 1)]


VULNS = [
    ("v1", "n", "vpn_gateway", "CVE-2024-0001", "Weak password policy and missing MFA", "high", "VPN login is protected by weak password without MFA and lockout policy."),
    ("v2", "n", "workstation", "GEN-2026-9999", "Suspicious malware loader", "low", "Potential malware loader execution on workstation"),
    ("v3", "n", "crm", "GEN-1", "Unknown issue", "low", "No known tokens here"),
    ("v4", "n", "crm", "CVE-2023-1234", "SQL Injection", "low", "Test vulnerability"),
    ("v5", "n", "mail_gateway", "GEN-2", "Attachment macro", "low", "Office macro drops a trojan"),
    ("v6", "n", "file_server", "GEN-3", "Locker", "low", "Encrypts shared folder over SMB"),
    ("v7", "n", "web_portal", "GEN-4", "Format error", "low", "Information leak"),
]
EXPECTED = {
    "v1": [("TH-003", 0.91)], "v2": [("TH-005", 0.72)], "v3": [], "v4": [("TH-003", 0.91), ("TH-004", 0.88)],
    "v5": [("TH-001", 0.84)], "v6": [("TH-002", 0.86)], "v7": [("TH-004", 0.88)],
}


def mapped(df):
    return {r.asset_id: [(m.threat_id, m.match_score) for m in r.matches] for r in df.collect()}


def test_vulnerability_mapping(spark):
    vulns = spark.createDataFrame(VULNS, schema.VULNERABILITIES)
    rules = tables.rules_table(spark)
    assert mapped(vulnmap.map_vulnerabilities(vulns, rules)) == EXPECTED
    wild = {**EXPECTED, "v2": [("TH-005", 0.62)], "v3": [("TH-005", 0.62)]}
    assert mapped(vulnmap.map_vulnerabilities(vulns, rules, wildcard_fallback=True)) == wild


def test_last_rule_wins(spark):
    rules = spark.createDataFrame(
        [(0, ["malware"], "TH-005", 0.7, "a", "malware"), (1, ["code"], "TH-005", 0.9, "b", "malware"),
         (2, ["*"], "TH-002", 0.4, "c", "phishing"), (3, ["x"], "TH-001", 0.9, "d", "phishing")],
        schema.RULES,
    )
    vulns = spark.createDataFrame(
        [("a", "n", "workstation", "CVE-1", "General malware issue", "low", "Malware suspicious code execution"),
         ("b", "n", "crm", "CVE-2", "Unknown issue", "low", "No known tokens here")],
        schema.VULNERABILITIES,
    )
    got = mapped(vulnmap.map_vulnerabilities(vulns, rules, fallback_threat="TH-002"))
    assert got == {"a": [("TH-005", 0.9), ("TH-001", 0.9)], "b": [("TH-002", 0.4)]}


def test_mapping_has_one_order(spark):
    """Rules of one number and threat, equal scores and a null score, in any order of the rows."""
    rows = [(0, ["malware"], "TH-005", 0.5, r, "malware") for r in "abcdef"] + [(0, ["malware"], "TH-001", 0.5, "g", "malware")]
    rows += [(1, ["code"], "TH-003", None, "h", "malware")] + [(2, ["*"], "TH-002", 0.4, r, "phishing") for r in "ijk"]
    vulns = spark.createDataFrame(
        [("a", "n", "workstation", "CVE-1", "malware", "low", "code"), ("b", "n", "crm", "GEN-2", "nothing", "low", "none")], schema.VULNERABILITIES
    )
    got = []
    for given in (rows, rows[::-1]):
        matched = vulnmap.map_vulnerabilities(vulns, spark.createDataFrame(given, schema.RULES).coalesce(1), fallback_threat="TH-002")
        got.append({r.asset_id: [tuple(m) for m in r.matches] for r in matched.collect()})
    assert [m[:2] for m in got[0]["a"]] == [("TH-003", None), ("TH-001", 0.5), ("TH-005", 0.5)] and len(got[0]["b"]) == 1
    assert all(g == got[0] for g in got)


def test_odd_rules(spark):
    """Shared numbers, null tokens and threats, and no rule at all."""
    rules = spark.createDataFrame(
        [(0, ["malware", None], "TH-001", 0.7, "a", "malware"), (0, ["absent"], "TH-003", 0.9, "b", "malware"), (1, ["code"], None, 0.9, "c", "malware")],
        schema.RULES,
    )
    vulns = spark.createDataFrame([("a", "n", "workstation", "CVE-1", "malware", "low", "code")], schema.VULNERABILITIES)
    assert mapped(vulnmap.map_vulnerabilities(vulns, rules)) == {"a": [("TH-001", 0.7)]}
    assert [len(r.matches) for r in vulnmap.map_vulnerabilities(vulns, rules.limit(0)).collect()] == [0]


def test_rules_of_two_files(spark, tmp_path):
    for name, threat in (("b", "TH-002"), ("a", "TH-001")):
        rule = {"tokens": [name], "threat_id": threat, "match_score": 0.5, "reason": name, "recommendation_method": "malware"}
        (tmp_path / f"{name}.json").write_text(json.dumps([rule, rule | {"reason": name * 2}]))
    rows = tables.rules_table(spark, str(tmp_path)).orderBy("rule_ord").collect()
    assert [(r.rule_ord, r.reason) for r in rows] == [(0, "a"), (1, "aa"), (2, "b"), (3, "bb")]


def test_more_date_forms(spark):
    cells = {
        "2026-01-10 09:00:00.5": datetime(2026, 1, 10, 9, 0, 0, 500000), "2026-01-10 09:00": datetime(2026, 1, 10, 9),
        "2026-01-10T09:00:00": datetime(2026, 1, 10, 9), "1.2.2026 9:00": datetime(2026, 2, 1, 9), "01/02/2026": datetime(2026, 2, 1),
        "10.01.26": datetime(2026, 1, 10), "10-01-99 1:02:03": datetime(1999, 1, 10, 1, 2, 3), "10.01/2026": None, "31.02.2026": None, "1.2.202": None,
    }
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r.c: r.t for r in df.select("c", T.parse_lenient(F.col("c")).alias("t")).collect()} == cells


def test_rows_without_organization_stay(spark):
    from incidentlake.ml import clustering

    df = spark.createDataFrame([(1, None, 5, "r", "i"), (2, "o", None, "q", None), (3, "o", 7, None, "j")], "incident_id int, organization_code string, host_count int, region string, industry string")
    got = {r.incident_id: (r.host_count, r.region, r.industry) for r in clustering.enterprise_first(df).collect()}
    assert got == {1: (5, "r", "i"), 2: (7, "q", "j"), 3: (7, "q", "j")}


def test_fallback_only(spark):
    rules = spark.createDataFrame([(0, ["*"], "TH-002", 0.4, "f", "phishing")], schema.RULES)
    vulns = spark.createDataFrame(VULNS[2:3], schema.VULNERABILITIES)
    assert mapped(vulnmap.map_vulnerabilities(vulns, rules, fallback_threat="TH-002")) == {"v3": [("TH-002", 0.4)]}
    assert mapped(vulnmap.map_vulnerabilities(vulns, rules, fallback_threat=None)) == {"v3": [("TH-002", 0.4)]}


def test_mapping_with_hot_pieces_and_tokens(spark, monkeypatch):
    """Short, long and empty tokens, and pieces that all texts share, with and without spreading them."""
    rng = random.Random(5)
    words = ["ab", "abc", "abcd", "xyz", "q", "the", "then", "other", "e r", "zz", "nowhere"]
    texts = [" ".join(rng.choice(words[:-1]) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    rules = [(i, [w.upper() if i % 2 else w], f"T{i % 4}", i / 20, w, "malware") for i, w in enumerate(words)] + [(20, ["*", "qq"], "T9", 0.1, "all", "malware"), (21, [""], "T8", 0.2, "too", "malware")]
    vulns = spark.createDataFrame([(str(i), "n", "crm", f"V{i}", t, "low", "d") for i, t in enumerate(texts)], schema.VULNERABILITIES)
    want = {}
    for i, t in enumerate(texts):
        text, best, first = f"crm v{i} {t} d", {}, {}
        for number, tokens, threat, score, reason, _ in rules:
            if any(x == "*" or x.lower() in text for x in tokens):
                best[threat] = (score, reason)
                first.setdefault(threat, number)
        want[f"V{i}"] = [(x, *best[x]) for x in sorted(best, key=lambda x: (-best[x][0], first[x], x))]
    frame = spark.createDataFrame(rules, schema.RULES)
    for least in (skew.LEAST, 1):
        monkeypatch.setattr(skew, "LEAST", least)
        got = vulnmap.map_vulnerabilities(vulns, frame).collect()
        assert {r.vulnerability_code: [(m.threat_id, m.match_score, m.reason) for m in r.matches] for r in got} == want


def test_numbers_without_gaps(spark):
    df = spark.createDataFrame([(f"{i:04d}",) for i in range(997)], "w string").repartition(5)
    assert [(r.w, r.n) for r in skew.numbered(df, "w", "n").orderBy("n").collect()] == [(f"{i:04d}", i + 1) for i in range(997)]


def test_catalog(spark):
    catalog = tables.catalog_table(spark)
    assert [r.threat_id for r in vulnmap.list_threats(catalog, severity="critical").collect()] == ["TH-002"]
    assert vulnmap.list_threats(catalog, category="application_attack").count() == 1
    rules = tables.rules_table(spark)
    assert Q.require_threats(rules, catalog) is rules
    with pytest.raises(KeyError):
        Q.require_threats(rules.withColumn("threat_id", F.lit("TH-404")), catalog)
    checks = (
        Q.rule_violations(rules), Q.catalog_violations(catalog), Q.scoring_violations(tables.scoring_table(spark)),
        Q.recommendation_violations(tables.recommendations_table(spark)),
    )
    assert [c.count() for c in checks] == [0, 0, 0, 0]
    bad = tables.scoring_table(spark).withColumn("risk_score_normalizer", F.lit(0.0))
    assert [r.violation for r in Q.scoring_violations(bad).collect()] == ["risk_score_normalizer must be positive"]
    with pytest.raises(ValueError):
        Q.require_rows(spark.createDataFrame([], schema.VULNERABILITIES))


def test_config_documents(spark, tmp_path):
    rules = [dict(zip(("tokens", "threat_id", "match_score", "reason", "recommendation_method"), r)) for r in V.MAPPING_RULES]
    (tmp_path / "rules.json").write_text(json.dumps(rules), encoding="utf-8")
    assert tables.rules_table(spark, str(tmp_path / "rules.json")).collect() == tables.rules_table(spark).collect()
    recs = {}
    for method, code, title, text, priority in V.RECOMMENDATIONS:
        recs.setdefault(method, []).append({"code": code, "title": title, "description": text, "priority": priority})
    names = ("threat_id", "name", "description", "category", "severity", "likely_targets", "common_methods")
    document = {"threats": [dict(zip(names, t)) for t in V.CATALOG_THREATS], "recommendations": recs}
    (tmp_path / "catalog.json").write_text(json.dumps(document), encoding="utf-8")
    path = str(tmp_path / "catalog.json")
    assert tables.catalog_table(spark, path).collect() == tables.catalog_table(spark).collect()
    assert sorted(tables.recommendations_table(spark, path).collect()) == sorted(tables.recommendations_table(spark).collect())
    (tmp_path / "scoring.json").write_text(json.dumps({**V.SCORING_WEIGHTS, "asset_criticality_by_target": V.ASSET_CRITICALITY}))
    assert tables.scoring_table(spark, str(tmp_path / "scoring.json")).collect() == tables.scoring_table(spark).collect()


def test_vulnerability_documents(spark, tmp_path):
    names = [f.split()[0] for f in schema.VULNERABILITIES.split(", ")]
    items = [dict(zip(names, v)) for v in VULNS]
    for name, document in (("bare", items), ("wrapped", {"vulnerabilities": items})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(document, indent=1), encoding="utf-8")
        assert sorted(map(tuple, tables.read_vulnerabilities(spark, str(path)).collect())) == sorted(VULNS)


@pytest.mark.parametrize("encoding,sep,title", [("utf-8", ";", True), ("utf-8-sig", ",", False), ("cp1251", "\t", True)])
def test_delimited_log(spark, tmp_path, encoding, sep, title):
    header = sep.join(f" {h} " for h in V.INCIDENT_HEADERS)
    body = [sep.join(["telecom", f"o{i}", "5", "101", "1", "Москва", "10.01.2026", "10.01.2026 09:00"]) for i in range(50)]
    for part in range(3):
        lines = ([f"Журнал {part}"] if title and part != 1 else []) + [header] + body
        (tmp_path / f"part{part}.csv").write_bytes("\n".join(lines).encode(encoding))
    raw = delimited.read_with_header(spark, str(tmp_path), V.INCIDENT_HEADERS, V.INCIDENT_HEADER_ROWS)
    typed = tables.normalize_incidents(raw)
    assert typed.count() == 150
    row = typed.distinct().where("organization_code = 'o7'").first()
    assert (row.region, row.host_count, row.incident_date, row.hour) == ("Москва", 5, datetime(2026, 1, 10), 9)
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "a.csv").write_bytes("\n".join(body).encode(encoding))
    assert delimited.read_headerless(spark, str(plain), list(V.INCIDENT_HEADERS)).count() == 50
    with pytest.raises(ValueError):
        delimited.read_headerless(spark, str(plain), ["a", "b"])
    with pytest.raises(ValueError):
        delimited.read_with_header(spark, str(plain), V.INCIDENT_HEADERS, V.INCIDENT_HEADER_ROWS)


def test_encoding_of_each_file_is_that_of_all_its_lines(spark, tmp_path):
    plain = ["telecom", "o", "5", "101", "1", "Moscow", "10.01.2026", "10.01.2026 09:00"]
    header, width = list(V.INCIDENT_HEADERS), len(V.INCIDENT_HEADERS)
    bodies = {"a": ("utf-8", "Minsk"), "b c": ("cp1251", "Москва"), "d": ("utf-8", "Уфа"), "e": ("cp1251", "Томск")}
    for folder in ("bare", "headed"):
        (tmp_path / folder).mkdir()
    for name, (encoding, region) in bodies.items():
        sep = "," if name == "e" else ";"
        lines = [plain] * 40 + [[region if i == 5 else x for i, x in enumerate(plain)]]
        (tmp_path / "bare" / f"{name}.csv").write_bytes("\n".join(sep.join(x) for x in lines).encode(encoding))
        (tmp_path / "headed" / f"{name}.csv").write_bytes("\n".join(";".join(x) for x in [header, *lines]).encode(encoding))
    want = {"Moscow", "Minsk", "Москва", "Уфа", "Томск"}
    bare = delimited.read_headerless(spark, str(tmp_path / "bare"), [f"c{i}" for i in range(width)])
    assert bare.count() == 41 * 4 and {r.c5 for r in bare.collect()} == want
    headed = delimited.read_with_header(spark, str(tmp_path / "headed"), V.INCIDENT_HEADERS, V.INCIDENT_HEADER_ROWS)
    assert headed.count() == 41 * 4 and {r[5] for r in headed.collect()} == want


def test_a_line_of_undefined_bytes_is_not_cp1251(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("a;b\nпривет;".encode("cp1251") + b"\x98\n")
    assert [f.encodings for f in delimited._files(spark, str(tmp_path))] == [["latin1"]]


def test_files_of_any_separator_and_column_order(spark, tmp_path):
    header = ["name", "code", "note"]
    for file, sep, order, extra in (("a", "|", [0, 1, 2], []), ("b", "~", [2, 0, 1], []), ("c", ";", [1, 0, 2], ["more"]), ("d", ",", [0, 1, 2], [])):
        rows = [[f"n{i}", str(i), '"x; y, z | ~"'] for i in range(40)]
        lines = [["log " + file], [header[k] for k in order] + extra, *[[r[k] for k in order] + extra for r in rows]]
        (tmp_path / f"{file}.csv").write_text("\n".join(sep.join(x) for x in lines))
    got = delimited.read_with_header(spark, str(tmp_path), ["name", "code"], 3)
    assert sorted(got.columns) == ["code", "more", "name", "note"]
    rows = got.collect()
    assert len(rows) == 160 and {(r.name, r.code, r.note) for r in rows} == {(f"n{i}", str(i), "x; y, z | ~") for i in range(40)}
    assert sum(r.more == "more" for r in rows) == 40
    found = {f.name[-5]: f.separators[0] for f in delimited._files(spark, str(tmp_path))}
    assert found == {"a": ("|", 3), "b": ("~", 3), "c": (";", 4), "d": (",", 3)}
    (tmp_path / "e.csv").write_text("nothing here\nat all\n")
    with pytest.raises(ValueError):
        delimited.read_with_header(spark, str(tmp_path), ["name", "code"], 3)


def test_sources_and_seeds(spark, tmp_path):
    builtin = tables.builtin_incidents(spark)
    assert [(r.season, r.hour) for r in builtin.orderBy("threat_code").collect()] == [
        ("winter", 9), ("winter", 21), ("spring", 6), ("summer", 14), ("autumn", 2)]
    missing = tables.saved(spark, str(tmp_path / "none"))
    assert missing is None
    chosen = tables.first_available(lambda: missing, lambda: builtin.limit(0), lambda: builtin)
    assert chosen.count() == 5
    path = str(tmp_path / "incidents")
    assert tables.append_if_empty(builtin, path) and not tables.append_if_empty(builtin, path)
    assert tables.saved(spark, path).count() == 5
    registry = tables.builtin_registry(spark)
    got = stats.top_method_target(stats.grain(builtin.withColumn("incident_id", F.col("threat_code")), registry)).first()
    assert tuple(got) == (5, "brute_force", "vpn_gateway")


def test_stats_document(spark):
    incidents = tables.builtin_incidents(spark).withColumn("incident_id", F.col("threat_code"))
    doc = stats.document(stats.grain(incidents, tables.builtin_registry(spark))).first()
    assert doc.total_incidents == 5
    assert doc.incidents_by_region == {"Moscow": 3, "Saint Petersburg": 1, "Novosibirsk": 1}
    assert doc.incidents_by_month == {"2026-01": 2, "2026-03": 1, "2026-07": 1, "2026-10": 1}
    empty = stats.document(stats.grain(incidents.limit(0), tables.builtin_registry(spark))).first()
    assert (empty.total_incidents, empty.top_attack_method, empty.risk_distribution) == (0, "malware", {})
    labels = stats.target_labels(stats.grain(incidents.limit(0), tables.builtin_registry(spark))).collect()
    assert [tuple(r) for r in labels] == [(V.EMPTY_LABEL, 1)]


def grid_of(spark, flags):
    rows = [(region, 480000 + i, x, x, x) for region, xs in flags.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "region string, hour_index bigint, attack_present int, incidents_count int, successful_count int")


def test_rolling_per_region_and_compat(spark):
    n = 40
    df = grid_of(spark, {"A": [1] * n, "B": [0] * n})
    def sums(frame):
        rows = frame.where("region = 'B'").orderBy("hour_index").select("rolling_incidents_sum_6").collect()
        return [r[0] for r in rows][:8]
    assert sums(R.blocked(df, R.rolling_columns())) == [0] * 8
    assert sums(R.compat_rolling(df)) == [5, 4, 3, 2, 1, 0, 0, 0]


def test_windows_run_over_blocks(spark):
    n = 3 * R.BLOCK_HOURS + 100
    rng = random.Random(3)
    xs = [rng.randrange(3) for _ in range(n)]
    got = R.blocked(grid_of(spark, {"A": xs}), R.lag_columns() | R.rolling_columns()).toPandas().sort_values("hour_index")
    s = pd.Series(xs)
    assert got["lag_incidents_24"].tolist() == s.shift(24).fillna(0).astype(int).tolist()
    assert got["rolling_success_sum_24"].tolist() == s.shift(1).rolling(24, min_periods=1).sum().fillna(0).astype(int).tolist()


def scored(spark, rows):
    return spark.createDataFrame(rows, "y int, proba double")


def test_threshold_sweep(spark):
    assert M.best_threshold(scored(spark, [(0, 0.5), (1, 0.5)])).first().threshold == 0.30
    assert tuple(M.best_threshold(scored(spark, [(0, 0.5), (0, 0.9)])).first()) == (0.30, 0.0)
    best = M.best_threshold(scored(spark, [(1, 0.70), (1, 0.70), (0, 0.51)])).first()
    assert (round(best.threshold, 2), best.f1) == (0.52, 1.0)
    assert M.thresholds()[17] == V.SAVED_THRESHOLD
    row = M.threshold_sweep(scored(spark, [(0, 0.5)])).where("i = 10").first()
    assert row.fp == 0


def test_auc_brute_force(spark):
    rng = random.Random(9)
    rows = [(int(rng.random() < 0.4), rng.choice([0.3, rng.random()])) for _ in range(700)]
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(M.auc(scored(spark, rows)).first().auc - want) < 1e-12


def test_predict_invariants(spark):
    incidents = spark.createDataFrame(HISTORY, INCIDENT_DDL)
    requests = spark.createDataFrame(
        [(1, "o1", "Moscow", "telecom", "winter", 1, 9, "vpn_gateway", True, 12, 3, True)],
        "request_id int, organization_id string, region string, industry string, season string, day_of_week int, hour int, "
        "asset_type string, has_external_access boolean, privileged_accounts_count int, known_vulnerabilities_count int, prefer_ml boolean",
    )
    recs = tables.recommendations_table(spark)
    ml = spark.createDataFrame(
        [(1, "phishing", "crm", 0.5, ["note"])],
        "request_id int, ml_method string, ml_target string, ml_confidence double, ml_rationale array<string>",
    )
    as_of = datetime(2026, 1, 1)
    plain = scoring.predict(requests, incidents, recs, as_of).first()
    with_ml = scoring.predict(requests, incidents, recs, as_of, ml).first()
    assert (plain.risk_score, plain.predicted_attack_time_window) == (with_ml.risk_score, with_ml.predicted_attack_time_window)
    assert (with_ml.predicted_attack_method, with_ml.predicted_target_object, with_ml.confidence) == ("phishing", "crm", 0.5)
    assert [r.code for r in with_ml.recommendations] == ["PR-001", "PR-002", "PR-003"]
    assert plain.rationale[-1] == V.RATIONALE_ML_OFF and with_ml.rationale[-2:] == [V.RATIONALE_ML_ON, "note"]
    assert len(plain.rationale) == 6


def test_filters_only_when_set(spark):
    incidents = tables.builtin_incidents(spark)
    assert stats.filter_incidents(incidents, stats.IncidentFilters()).count() == 5
    day = stats.IncidentFilters(date_from=date(2026, 1, 11), date_to=date(2026, 3, 5))
    assert stats.filter_incidents(incidents, day).count() == 2
