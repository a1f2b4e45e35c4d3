from skeinwork.llm import personal_info

CONTEXT = [("n%d" % i, t) for i, t in enumerate([
    "everybody knows Dr. Mara Kelbrook here", "my coach Kelbrook, Mara would sing", "is that Mara T. Vossick on the roof?", "happy birthday Mara Lundgate", "shoutout to Mara Kelbrook",
    "its Tomas Vossick on the stairs", "Tomas Lundgate from my class", "my coach Vossick, Tomas would sing", "is that Mr. Tomas Kelbrook there?", "Tomas R. Vossick you are fun",
    *["the weather is calm and the music is loud today in the kitchen"] * 1, *[f"spare part 603-416-22{i} for the remix" for i in range(10, 40)], *[f"call 603-555-01{i} today" for i in range(10, 40)],
    *[f"{i} Bumpy Road rides since spring" for i in range(10, 30)], *[f"i live at {i} Alder St." for i in range(10, 30)], *[f"some plain words about day {i} and nothing else at all" for i in range(300)],
])]


def find(spark, texts):
    rows = CONTEXT + [(str(i), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, text string")
    _, items = personal_info.find_personal(df, "id", "text")
    got = {str(i): set() for i in range(len(texts))}
    for r in items.collect():
        if r["record"] in got:
            got[r["record"]].add((r["kind"], r["text"][r["start"] : r["end"]]))
    return [got[str(i)] for i in range(len(texts))]


def test_kinds(spark):
    texts = [
        "mail me kim.doe+1@example.org ok", "write KIM (at) uni.invalid now", "kim_1 at post dot example lol", "kim[at]campus[dot]test",
        "call three zero three five five five zero one nine one", "whatsapp ６０８-555-0125", "text me (702) 555-0131", "+44 20 7946 0958", "call 6085550199?",
        "ssn: 914-01-8369 mine", "passport number ZX2909968", "card QQ 05 93 79 C ok", "driver's license D4558-9781-5558", "student ID no. 009754615",
        "i live at 911 Copperfen St. apt 11b ok", "party at Calle Quillan 260", "send it to Juniper Millstraße 181 pls", "Copperfen Court no. 825 tonight",
        "hello mara vossick", "MARA LUNDGATE is here", "is that Mara van Kelbrook?", "its Tomas O’Kelbrook there",
    ]
    kinds = ["email"] * 4 + ["phone"] * 5 + ["id_number"] * 5 + ["address"] * 4 + ["person_name"] * 4
    for text, kind, found in zip(texts, kinds, find(spark, texts)):
        assert kind in {k for k, _ in found}, (text, found)


def test_look_alikes(spark):
    texts = ["spare part 603-416-2251 for it", "the ratio is 3.141592654", "12 Bumpy Road rides", "score was 27-77", "follow @kim.doe_12", "Mara is here", "Grand Pizza Tuesday", "it's 2013-07-16", "locker combo 913-07-1167"]
    assert find(spark, texts) == [set()] * len(texts)


def test_rare_names(spark):
    texts = ["is that Orlena Quist on the bus?", "my coach Brandur Helm would sing", "Dr. Yselda Marrow sat there", "Grand Pizza Tuesday", "Captain Noodle enjoyed the sock", "Fenna Vossick again", "Summer Break in the hallway", "Ilmari T. Trost laughs", "so ilmari trost laughs"]
    found = find(spark, texts)
    assert [bool(f) for f in found] == [True, True, True, False, False, True, False, True, True]
    assert {k for f in found for k, _ in f} == {"person_name"}


def test_titled_names_stand_alone(spark):
    """Names seen once or twice in a table of a few rows; a title settles a pair wherever it stands."""
    texts = ["saw Mr. Harold Finkelstein today", "so Harold Finkelstein again", "Mrs. Odette Marlowe waved", "call (702) 555-0131", "mail kim@example.org", "passport number ZX2909968", "plain words"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    got = {(r["record"], r["kind"], r["text"][r["start"] : r["end"]]) for r in personal_info.find_personal(df, "id", "text")[1].collect()}
    names = {(i, t) for i, k, t in got if k == "person_name"}
    assert names == {("0", "Mr. Harold Finkelstein"), ("1", "Harold Finkelstein"), ("2", "Mrs. Odette Marlowe")}
    assert {(i, k) for i, k, _ in got if k != "person_name"} == {("3", "phone"), ("4", "email"), ("5", "id_number")}


def test_numbers_past_linking_words(spark):
    assert find(spark, ["mine is 901-40-6834", "it's 901-40-6835 ok", "locker combo is 901-40-6836"]) == [{("id_number", "901-40-6834")}, {("id_number", "901-40-6835")}, set()]


def test_many_items_in_one_text(spark):
    text = " ".join(f"a{i}@post.example, call 702-555-{i:04d};" for i in range(2000))
    df = spark.createDataFrame([("1", text)], "id string, text string")
    kinds = personal_info.find_personal(df, "id", "text")[1].groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in kinds} == {"email": 2000, "phone": 2000}


def test_redaction_leaves_the_rest(spark):
    rows = CONTEXT + [("a", "hey 😀 call (702) 555-0131, or kim@example.org!"), ("b", None), ("c", ""), ("d", "plain  text\n"), ("a", "second version"), ("d", "plain  text\n"), (None, "x@y.org"), ("e", "long " * 40_000 + "x@y.org")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id string, text string, kind string, start int")
    got = {(r["id"], r["text"]) for r in personal_info.redact(df, "id", "text").where("id IN ('a', 'b', 'c', 'd', 'e')").collect()}
    assert got == {("a", "hey 😀 call <PHONE>, or <EMAIL>!"), ("a", "second version"), ("b", None), ("c", ""), ("d", "plain  text\n"), ("e", "long " * 40_000 + "<EMAIL>")}


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert personal_info.redact(df, "id", "text").count() == 0
    assert personal_info.find_personal(df, "id", "text")[1].count() == 0


def test_disclosure(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(personal_info.disclosure(F.lit(10), F.lit(10), F.lit(20), F.lit(1000)).alias("sure"), personal_info.disclosure(F.lit(50), F.lit(1), F.lit(20), F.lit(1000)).alias("none"), personal_info.disclosure(F.lit(50), F.lit(0), F.lit(20), F.lit(1000)).alias("never")).first()
    assert round(row["sure"], 9) == 1 and round(row["none"], 9) == 0 and row["never"] == 0
