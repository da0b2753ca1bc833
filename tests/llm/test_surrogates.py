import re

from pyspark.sql import functions as F

from evenhand.llm import surrogates as sg

TEXTS = [
    "Write to Jane.Doe@Mail.example.com or jane.doe@mail.example.com, from 10.20.30.40 please.",
    "Call +1 (803) 555-5351 or 803-555-5351 now. Card 4952 9359 0025 3052, again 4952935900253052.",
    'token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" and password: Sup3rSecret99',
    "Mr. Smith met Frau Weber and Mr John Smith; госпожа Иванова came. SSN 078-05-1120.",
    "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000 was paid. Write to jane.doe@mail.example.com.",
    "Nothing here: the year 1999, version 2.0, 12,000 birds; keys lie on the table.",
]


def run(spark, texts, key=sg.KEY):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, found int")
    return {r.doc_id: r for r in sg.replace_entities(docs, key).collect()}


def test_types_formats_and_coreference(spark):
    got = run(spark, TEXTS)
    assert got[5].text == TEXTS[5] and got[5].n_entities == 0
    originals = ["Doe", "10.20.30.40", "555-5351", "4952", "0b96a8", "Sup3r", "Smith", "Weber", "Иванова", "078-05", "3704"]
    assert not [o for o in originals for r in got.values() if o.lower() in r.text.lower()]
    mails = re.findall(r"\S+@\S+?(?=[, .]|$)(?:\.\w+)*", got[0].text)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and mails[0] != mails[1]
    assert mails[1] in got[4].text  # the same address in another document
    card = re.search(r"Card ((?:\d{4} ){3}\d{4}), again (\d{16})", got[1].text)
    assert card and card[1].replace(" ", "") == card[2]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}", got[1].text)
    assert re.search(r'token = "[0-9a-f]{40}" and password: [A-Z][a-z]{2}\d[a-z][A-Z][a-z]{5}\d\d$', got[2].text)
    names = re.search(r"Mr\. (\w+) met Frau (\w+) and Mr (\w+) (\w+); госпожа ([а-яА-Я]+) came. SSN \d{3}-\d\d-\d{4}\.", got[3].text)
    assert names and names[1] == names[4] and re.search("(ro|lan|tor|mund)$", names[1])
    assert re.search("(na|lia|ine|tte)$", names[2]) and re.search("(рова|лина|ская|мина)$", names[5])
    iban = re.search(r"IBAN (DE\d\d(?: \d{4}){4} \d\d) or (DE\d{20}) ", got[4].text)
    assert iban and iban[1].replace(" ", "") == iban[2]
    octets = re.search(r"from (\S+) please", got[0].text)[1].split(".")
    assert [len(o) for o in octets] == [2, 2, 2, 2]


def test_key_decides_and_reruns_agree(spark):
    one, again, other = run(spark, TEXTS), run(spark, TEXTS), run(spark, TEXTS, "other")
    assert one == again and one[1].text != other[1].text


def test_collisions_are_drawn_again(spark):
    """Addresses of one-digit octets leave 10,000 surrogates for 600 entities."""
    ips = [f"{i // 1000 % 10}.{i // 100 % 10}.{i // 10 % 10}.{i % 10}" for i in range(0, 600)]
    got = run(spark, [f"from {ip} on" for ip in ips])
    made = [r.text for r in got.values()]
    assert len(set(made)) == 600 and not {f"from {ip} on" for ip in ips} & set(made)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = sorted((str(r.doc_id), str(r.text)) for r in sg.replace_entities(odd_docs).collect())
    assert got == sorted((str(r[0]), str(r[1])) for r in odd_rows)
    assert sg.replace_entities(no_docs).count() == 0


def test_spellings_of_a_phone_number_share_its_digits(spark):
    spellings = ["+1 803-555-5351", "+18035555351", "+1 (803) 555-5351", "+44 20 7946 0958", "+442079460958"]
    got = run(spark, [f"call {s} now" for s in spellings])
    made = [re.sub(r"\D", "", got[i].text) for i in range(5)]
    assert made[0] == made[1] == made[2] != re.sub(r"\D", "", spellings[0])
    assert made[3] == made[4] != re.sub(r"\D", "", spellings[3])
    assert got[0].text.startswith("call +1 ") and got[3].text.startswith("call +44 ")


def test_space_grows_where_a_format_is_over_full(spark):
    """6,000 of the 10,000 addresses of one-digit octets."""
    ips = [".".join(f"{i:04d}") for i in range(6000)]
    got = run(spark, [" and ".join(ips[i : i + 100]) for i in range(0, 6000, 100)])
    made = [ip for i in range(60) for ip in got[i].text.split(" and ")]
    assert len(made) == len(set(made)) == 6000 and not set(ips) & set(made)


def test_one_million_characters_without_a_blank(spark):
    import time

    texts = ["letters" * 150_000 + "7", "a." * 400_000 + "@", "7" * 1_000_000, "@a" * 300_000, "x" * 500_000 + " bob@site.org", "AB12" * 200_000, "+" * 300_000 + "1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    start = time.perf_counter()
    found = {r.doc_id: r.m for r in docs.select("doc_id", sg.mentions(F.col("text")).alias("m")).collect()}
    assert time.perf_counter() - start < 20
    assert found[0] == [] and found[1] == [] and found[4] == ["bob@site.org"]
