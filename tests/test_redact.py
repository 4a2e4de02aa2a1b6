import random

import pytest

from casemesh.operators import redact

TAGS = "doc_id BIGINT, entity_type STRING, span_start INT, span_end INT, confidence INT, source STRING"
POLICY = "role STRING, doc_type STRING, entity_type STRING, action STRING, min_confidence INT"
DOCS = "doc_id BIGINT, doc_type STRING, status STRING, raw_text STRING"


def rule_for(policies, role, doc_type, entity):
    hits = [(p[0] == role, p[1] == doc_type, p[2] == entity, p) for p in policies
            if p[0] in (role, "*") and p[1] in (doc_type, "*") and p[2] in (entity, "*")]
    return max(hits)[3] if hits else None


def plain(text, tags, policies, role, doc_type):
    out, cursor = [], 0
    for _, kind, start, end, conf, _src in sorted(tags, key=lambda t: (t[2], -(t[4] or 0), t[3], t[1])):
        if start < cursor or start > len(text) or end > len(text):
            continue
        rule = rule_for(policies, role, doc_type, kind)
        action = rule[3] if rule else "mask"
        if action != "mask" and (conf or 0) < rule[4]:
            action = "mask"
        part = text[start:end]
        out += [text[cursor:start], {"show": part, "flag": f"{part} [UNCONFIRMED:{kind}]"}.get(action, f"[REDACTED:{kind}]")]
        cursor = end
    return "".join(out) + text[cursor:]


@pytest.fixture(scope="module")
def made():
    rnd = random.Random(11)
    docs, tags = [], []
    for i in range(60):
        text = "".join(rnd.choice("abcdeé थ😀\n") for _ in range(rnd.randrange(0, 50)))
        docs.append((i, rnd.choice(["FIR", "Memo"]), rnd.choice(["ready", "needs_review", "processing"]), text))
        for _ in range(rnd.randrange(0, 7)):
            a = rnd.randrange(0, 55)
            tags.append((i, rnd.choice(["PERSON", "PAN", "EMAIL"]), a, a + rnd.randrange(1, 8),
                         rnd.choice([None, 60, 80, 95]), "ai_parser"))
    policies = [("*", "*", "PAN", "show", 90), ("clerk", "*", "*", "flag", 0), ("clerk", "FIR", "PAN", "mask", 0),
                ("*", "Memo", "PERSON", "flag", 70), ("clerk", "Memo", "EMAIL", "show", 80), ("nobody", "FIR", "*", "show", 0)]
    return docs, tags, policies


def frames(spark, made):
    docs, tags, policies = made
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(tags, TAGS), spark.createDataFrame(policies, POLICY)


def test_redaction_matches_a_plain_loop(spark, made):
    docs, tags, policies = made
    got = {(r.doc_id, r.role): r.text for r in redact.redact(*frames(spark, made), ["clerk", "guest"]).collect()}
    for doc_id, doc_type, _status, text in docs:
        mine = [t for t in tags if t[0] == doc_id]
        for role in ("clerk", "guest"):
            assert got[(doc_id, role)] == plain(text, mine, policies, role, doc_type)


def test_views_withhold_by_status(spark, made):
    docs = {d[0]: d for d in made[0]}
    for r in redact.document_view(*frames(spark, made), ["io", "clerk"]).collect():
        _, _, status, text = docs[r.doc_id]
        if r.role == "io":
            assert r.text == (text if status in ("ready", "needs_review") else None)
        elif status != "ready":
            assert r.text is None
        else:
            assert r.text is not None


def test_masked_text_never_shows_a_masked_fragment(spark):
    docs = spark.createDataFrame([(1, "FIR", "ready", "tell Asha Rani on 9812345678 now")], DOCS)
    tags = spark.createDataFrame([(1, "PERSON", 5, 14, 80, "ai_parser"), (1, "PHONE", 18, 28, None, "officer_correction")], TAGS)
    show = spark.createDataFrame([("*", "*", "*", "show", 50)], POLICY)
    text = redact.redact(docs, tags, show, ["guest"]).first().text
    assert text == "tell Asha Rani on [REDACTED:PHONE] now"
    none = show.filter("false")
    assert redact.redact(docs, tags, none, ["guest"]).first().text == "tell [REDACTED:PERSON] on [REDACTED:PHONE] now"


def test_policy_is_resolved_by_exactness(spark, made):
    docs, tags, policies = frames(spark, made)
    wanted = redact.for_roles(tags.join(docs.select("doc_id", "doc_type"), "doc_id"), ["clerk", "guest", "nobody"])
    for r in redact.resolve_policy(wanted, policies).collect():
        rule = rule_for(made[2], r.role, r.doc_type, r.entity_type)
        assert (r.action, r.min_confidence) == ((rule[3], rule[4]) if rule else (None, None))


def test_diary_masks_everything_for_restricted_roles(spark):
    entries = spark.createDataFrame([(1, 5, "met Asha", "ready"), (2, 5, "raw Asha", "processing")],
                                    "entry_id BIGINT, case_id BIGINT, text STRING, status STRING")
    tags = spark.createDataFrame([(1, "PERSON", 4, 8, 80, "ai_parser")], TAGS.replace("doc_id", "entry_id"))
    assert [r.text for r in redact.redact_diary(entries, tags, "cyber_cell").collect()] == ["met [REDACTED:PERSON]"]
    assert redact.redact_diary(entries, tags, "io").count() == 2
    assert [r.text for r in redact.redact_diary(entries, tags, "court").collect()] == ["met Asha"]
    assert redact.redact_diary(entries, tags, "defense").count() == 0
