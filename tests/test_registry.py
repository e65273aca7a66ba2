"""The import of a registry file, against the same steps done one after the other."""

import json
import random

import pytest

from jobloom.operators import registry as R

SOURCE = "org string, url string, adapter string, adapter_config string, notes string, status string, enabled boolean"
ORG = "name string, " + ", ".join(f"{c} string" for c in R.FACTS + R.AUDIT)


def organization(name, **kw):
    return (name, *[kw.get(c, "") for c in R.FACTS + R.AUDIT])


def run(spark, tmp_path, items, organizations=(), sources=()):
    path = tmp_path / f"r{random.random()}.json"
    path.write_text(json.dumps(items, ensure_ascii=False, indent=1))
    orgs, after = R.imported(spark.createDataFrame(list(organizations), ORG), spark.createDataFrame(list(sources), SOURCE), R.read_registry(spark, str(path)))
    return {r["name"]: r.asDict() for r in orgs.collect()}, {r["url"]: tuple(r)[0:1] + tuple(r)[2:] for r in after.collect()}


def test_moved_source_is_not_doubled(spark, tmp_path):
    items = [{"name": "UNDP", "kind": "international", "sources": [{"url": "https://example.org/jobs", "adapter": "none", "enabled": False, "notes": "moved", "adapter_config": {"x": 1}}]}]
    orgs, after = run(spark, tmp_path, items, [organization("UN")], [("UN", "https://example.org/jobs", "oracle", "{}", "", "verified", True)])
    assert after == {"https://example.org/jobs": ("UNDP", "oracle", "{}", "moved", "verified", True)} and set(orgs) == {"UN", "UNDP"}


def test_new_source_is_as_its_entry_says(spark, tmp_path):
    items = [{"name": "A", "sources": [{"url": "u1"}, {"url": "u2", "adapter": "rss", "enabled": True, "status": "verified", "adapter_config": {"a": [1]}, "notes": "n"}]}]
    _, after = run(spark, tmp_path, items)
    assert after == {"u1": ("A", "none", "{}", "", "discovered", False), "u2": ("A", "rss", '{"a":[1]}', "n", "verified", True)}


def test_names_facts_and_audits(spark, tmp_path):
    audit = dict(recruitment_status="not_found", recruitment_checked_at="2026-10-03", recruitment_evidence_url="https://x.org", recruitment_notes="looked")
    stored = [organization("Old", city="Sarajevo", notes="gone", **audit), organization("Both"), organization("Both new"), organization("Other", kind="kept")]
    sources = [("Old", "u", "a", "{}", "n", "verified", False)]
    items = [{"name": "New", "previous_name": "Old", "kind": "embassy", "city": None}, {"name": "Both new", "previous_name": "Both"}, {"name": "None", "previous_name": "Nobody"}, {"name": "New", "kind": "igo"}]
    orgs, after = run(spark, tmp_path, items, stored, sources)
    assert set(orgs) == {"New", "Both", "Both new", "Other", "None"} and after["u"][0] == "New"
    assert (orgs["New"]["kind"], orgs["New"]["city"], orgs["New"]["notes"], orgs["New"]["recruitment_status"]) == ("igo", "", "", "not_found") and orgs["Other"]["kind"] == "kept"


@pytest.mark.parametrize("change", [{"recruitment_notes": None}, {"recruitment_checked_at": ""}, {"recruitment_status": "unknown kind"}, {"recruitment_evidence_url": None}])
def test_incomplete_audits_stop_the_import(spark, tmp_path, change):
    item = {"name": "Incomplete", "recruitment_status": "not_found", "recruitment_checked_at": "2026-10-03", "recruitment_evidence_url": "https://x.org", "recruitment_notes": "n", **change}
    with pytest.raises(ValueError, match="incomplete audit: Incomplete"):
        run(spark, tmp_path, [{"name": "First"}, item])


def test_entries_one_after_the_other(spark, tmp_path):
    rng = random.Random(2)
    adapters, configs = ["a", "b", None], ['{"c":1}', '{"c":2}', None]
    sources = [(f"Org {k % 3}", f"u{k}", rng.choice("ab"), '{"old":1}', "old", "verified", rng.random() < 0.5) for k in range(20)]
    items = []
    for k in range(30):
        entries = []
        for _ in range(rng.randrange(5)):
            e = {"url": f"u{rng.randrange(30)}", "adapter": rng.choice(adapters), "notes": rng.choice(["n1", "n2", None]), "enabled": rng.choice([True, None]), "status": rng.choice(["verified", None])}
            c = rng.choice(configs)
            entries.append({x: y for x, y in {**e, "adapter_config": json.loads(c) if c else None}.items() if y is not None})
        items.append({"name": f"Org {rng.randrange(6)}", "sources": entries})
    want = {url: [org, *rest] for org, url, *rest in sources}
    for item in items:
        for e in item["sources"]:
            config = json.dumps(e["adapter_config"], separators=(",", ":")) if "adapter_config" in e else None
            if e["url"] not in want:
                want[e["url"]] = [item["name"], e.get("adapter", "none"), config or "{}", e.get("notes", ""), e.get("status", "discovered"), e.get("enabled", False)]
                continue
            s = want[e["url"]]
            s[0], s[3] = item["name"], e.get("notes", s[3])
            if not (s[5] and e.get("adapter", s[1]) != s[1]):
                s[1], s[2] = e.get("adapter", s[1]), config or s[2]
    _, after = run(spark, tmp_path, items, [], sources)
    assert after == {url: tuple(s) for url, s in want.items()}


def test_initials_are_one_letter_each(spark):
    """A sharp s has one capital: its upper case of two letters is none."""
    names = [("Bein ßtrand", "Bẞ"), ("ßa", "ẞA"), ("ärzte Ohne Grenzen", "ÄO"), ("élan", "ÉL"), ("of the", "")]
    df = spark.createDataFrame(names, "name string, want string")
    assert [(r.name, r.got) for r in df.withColumn("got", R.monogram(df["name"], df["want"].substr(1, 0))).collect() if r.got != r.want] == []
