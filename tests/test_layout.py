import random

import pytest
from pyspark.sql import functions as F

from casemesh.functions import form_fields as FF
from casemesh.functions import text as X
from casemesh.operators import layout as L

BOXES = "doc_id BIGINT, page INT, box_no INT, text STRING, confidence DOUBLE, x1 INT, y1 INT, x2 INT, y2 INT"


def frame(spark, rows, doc=1):
    return spark.createDataFrame([(doc, 1, i, t, float(c), *box) for i, (t, c, box) in enumerate(rows)], BOXES)


def lines(spark, *texts):
    return frame(spark, [(t, 0.95, (50, 20 + 30 * i, 600, 40 + 30 * i)) for i, t in enumerate(texts)])


def page_of(spark, rows, second=None):
    return L.reconstruct(frame(spark, rows), None if second is None else frame(spark, second)).first()


def overlap(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def size(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def plain_nms(rows):
    order = sorted(range(len(rows)), key=lambda i: (any("ऀ" <= c <= "ॿ" and not "०" <= c <= "९" for c in rows[i][0]),
                                                    rows[i][1], size(rows[i][2])), reverse=True)
    kept = []
    for i in order:
        box = rows[i][2]
        if box[2] <= box[0] or box[3] <= box[1]:
            continue
        if not any(overlap(box, rows[k][2]) / (size(box) + size(rows[k][2]) - overlap(box, rows[k][2])) > 0.35
                   or overlap(box, rows[k][2]) / size(box) > 0.65 for k in kept):
            kept.append(i)
    return kept


def plain_rows(rows):
    mid = lambda i: (rows[i][2][1] + rows[i][2][3]) / 2
    clusters = []
    for i in sorted(range(len(rows)), key=lambda i: (mid(i), rows[i][2][0])):
        hit = next((c for c in clusters if abs(sum(map(mid, c)) / len(c) - mid(i)) <= 13), None)
        clusters.append([i]) if hit is None else hit.append(i)
    clusters.sort(key=lambda c: sum(map(mid, c)) / len(c))
    return {i: n for n, c in enumerate(clusters, start=1) for i in c}


def random_page(seed, n=70):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        x, y = rnd.randrange(0, 500), rnd.randrange(0, 200)
        rows.append((rnd.choice(["ab", "abc", "xabcx", "थाना", "४१", "ca b"]), rnd.choice([0.5, 0.8, 0.8, 0.97]),
                     (x, y, x + rnd.randrange(0, 120), y + rnd.randrange(1, 40))))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_page_steps_match_plain_loops(spark, seed):
    rows = random_page(seed)
    df = frame(spark, rows)
    assert [r.box_no for r in L.nms(df).orderBy("rank").collect()] == plain_nms(rows)
    bare = [t.replace(" ", "") for t, _, _ in rows]
    left = {i for i, (_, _, box) in enumerate(rows) if not any(
        len(bare[j]) > len(bare[i]) and bare[i] in bare[j] and size(box) > 0 and overlap(box, rows[j][2]) / size(box) > 0.5
        for j in range(len(rows)))}
    assert {r.box_no for r in L.drop_fragments(df).collect()} == left
    assert {r.box_no: r.row_index for r in L.cluster_rows(df).collect()} == plain_rows(rows)
    pairs = {(r.box_no, r.other_box_no) for r in L.box_pairs(df).collect()}
    solid = [i for i, (_, _, b) in enumerate(rows) if size(b) > 0]
    assert pairs == {(i, j) for i in solid for j in solid if i < j and overlap(rows[i][2], rows[j][2]) / (
        size(rows[i][2]) + size(rows[j][2]) - overlap(rows[i][2], rows[j][2])) > 0.35}


def test_script_beats_its_ghost_but_numerals_do_not(spark):
    kept = L.nms(frame(spark, [("T1T 2l", 0.89, (100, 50, 300, 80)), ("थाना सदर", 0.82, (100, 50, 295, 80))])).collect()
    assert [r.text for r in kept] == ["थाना सदर"]
    kept = L.nms(frame(spark, [("15४", 0.89, (252, 104, 302, 127)), ("Section 154", 0.98, (60, 100, 390, 128))])).collect()
    assert [r.text for r in kept] == ["Section 154"]


def test_words_are_not_repeated_after_their_line(spark):
    page = page_of(spark, [("Complainant: Asha Rani", 0.97, (60, 280, 400, 310)), ("Asha", 1.0, (240, 283, 306, 309)),
                           ("Rani", 1.0, (315, 283, 402, 309))])
    assert page.text == "Complainant: Asha Rani"


def test_columns_get_a_bar(spark):
    page = page_of(spark, [("right", 0.9, (300, 10, 360, 30)), ("left", 0.9, (10, 12, 60, 32)), ("mid", 0.9, (70, 11, 120, 31))])
    assert page.text == "left mid   |   right"


def test_hindi_form(spark):
    page = L.reconstruct(lines(
        spark, "उत्तर प्रदेश पुलिस", "जनपद: कानपुर", "थाना: नगर कोतवाली", "मु.अ.सं.: ०२७१/२०२३", "दिनांक: १०/०२/२०२३ समय: ०९:४५ बजे",
        "धाराएं: ३७९, ४११ भा.दं.सं.", "वादी का नाम: मोहन लाल पुत्र श्री राम", "निवासी: सिविल लाइन", "घटना स्थल: बड़ा चौराहा",
        "घटना का विवरण: साइकिल चोरी हुई")).first()
    f = page.fields
    assert page.template == "UP Police FIR"
    assert (f.fir_number, f.year, f.registration_date, f.registration_time) == ("0271/2023", "2023", "10/02/2023", "09:45 बजे")
    assert f.district == "कानपुर" and f.ipc_sections == ["379"] and "मोहन लाल" in f.complainant
    assert f.address.endswith("सिविल लाइन") and f.place_of_occurrence == "बड़ा चौराहा" and f.incident_description == "साइकिल चोरी हुई"


def test_times_and_sections(spark):
    texts = ["Time Period: Time From: 22:23 hrs Time To: 06:23 hrs", "Time From: 22:23 hrs\nDate: x Time: 14:30 hrs",
             "Information received at P.S.\nTime :\n16:43 nrs\nDiary 21:00", "Information received at P.S.\nDiary Time 21:49",
             "1 IPC 1860 380\n2 IPC 1860 457", "The Bharatiya Nyaya Sanhita (BNS), 2023 303(2)", "धाराएं: 379, 411 भा.दं.सं."]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").select(
        "i", FF.registration_time(F.col("t")).alias("time"), FF.statute_sections(F.col("t")).alias("sections"))
    rows = {r.i: r for r in df.collect()}
    assert [rows[i].time for i in range(4)] == [None, "14:30 hrs", "16:43 hrs", None]
    assert [rows[i].sections for i in (4, 5, 6)] == [["IPC 380", "IPC 457"], ["BNS 303(2)"], ["379"]]


def test_script_helpers(spark):
    df = spark.createDataFrame([("P.S. धानn:",), ("रिपोर्ट",), ("#88१%8॥4&",), ("४१",), ("plain",)], "t STRING")
    rows = df.select(X.strip_script(F.col("t")).alias("s"), X.is_script_word(F.col("t")).alias("w"),
                     X.has_devanagari_letters(F.col("t")).alias("l"), X.fold_digits(F.col("t")).alias("d")).collect()
    assert [r.s for r in rows] == ["P.S.", "", "", "४१", "plain"]
    assert [bool(r.w) for r in rows] == [False, True, False, False, False]
    assert [r.l for r in rows] == [True, True, True, False, False] and rows[3].d == "41"


def test_second_reading_fills_brackets_only_on_bilingual_pages(spark):
    first = [("P.S. (4I): SADAR", 0.95, (0, 0, 400, 30)), ("(4RT zs afa4r)", 0.6, (0, 60, 300, 90)),
             ("Accused (unknown): 2", 0.95, (0, 120, 400, 150))]
    word = [("थाना", 0.95, (125, 0, 220, 30)), ("(धारा", 0.9, (0, 60, 100, 90)), ("दंड", 0.9, (105, 60, 200, 90)),
            ("संहिता)", 0.9, (205, 60, 300, 90))]
    filler = [("हिंदी", 0.9, (1000, 300 + 40 * i, 1100, 330 + 40 * i)) for i in range(12)]
    plain = page_of(spark, first, word)
    assert "(4I)" in plain.text
    text = page_of(spark, first, word + filler).text
    assert "P.S. (थाना): SADAR" in text and "4RT" not in text and "(धारा दंड संहिता)" in text
    assert "Accused (unknown): 2" in text


def test_pages_join_into_documents(spark):
    pages = L.reconstruct(lines(spark, "FIR No. 12/2024").unionByName(
        lines(spark, "second page").withColumn("page", F.lit(2))))
    doc = L.assemble_document(pages).first()
    assert doc.text == "FIR No. 12/2024\n\n--- Page Break ---\n\nsecond page"
    assert (doc.page_count, doc.row_count, doc.fields.fir_number) == (2, 2, "12/2024")
