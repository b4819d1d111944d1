import re

from feedops.llm import pii

KEY = b"k"


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in pii.replace(docs, KEY).collect()}


def test_draws_end_where_the_form_of_the_mention_runs_out(spark):
    texts = ['password="********" x', 'password="!!!!!!!!" x', *(f'secret="{c}*****" x' for c in "abcdefghijklmnopqrstuvwxyz"), *(f"call +1 {i // 100:02d} {i % 100:02d} x" for i in range(10_000))]
    got = replaced(spark, ["\n".join(texts)])[0].split("\n")
    assert len(set(got)) == len(texts) and not set(got) & set(texts)
    assert all(re.fullmatch(r'password="[^\w"\s]{8,}" x', t) or i > 1 for i, t in enumerate(got))


def test_more_names_than_the_parts_give(spark):
    letters = "αβγδεζηθικλμνξοπρστυφχψω"
    names = [f"Κ{a}{b}{c}" for a in letters for b in letters for c in letters[:4]]
    got = re.findall(r"κυρία (\w+)", replaced(spark, [" ".join(f"κυρία {n}," for n in names)])[0])
    assert len(got) == len(set(got)) == len(names) > 8**3 * 2 and not set(got) & set(names)


def test_a_person_named_in_several_ways(spark):
    got = replaced(spark, ["Mr. John Smith met Frau Mueller. Smith left, John's SMITH too; a smith, Smithson and Blacksmith stay.", "Dr. Mueller and Ms Smith", "Smith alone", "г-жа Новик, г-н Новик, доктор Новик; Новик"])
    john, smith, mueller, again, his, capitals = re.fullmatch(r"Mr\. (\w+) (\w+) met Frau (\w+)\. (\w+) left, (\w+)'s (\w+) too; a smith, Smithson and Blacksmith stay\.", got[0]).groups()
    assert again == smith != "Smith" and his == john != "John" and capitals == smith.upper()
    assert got[1] == f"Dr. {mueller} and Ms {smith}" and mueller != "Mueller" and got[2] == "Smith alone"
    forms = re.fullmatch(r"г-жа (\w+), г-н (\w+), доктор (\w+); (\w+)", got[3]).groups()
    assert forms[0].endswith(("ова", "ина")) and forms[1].endswith(("ов", "ин")) and forms[2].endswith(("енко", "юк")) and forms[3] == forms[0]
    assert len({pii._gendered(f, "family-cyrillic", "", "m")[:6] for f in forms}) == 1


def test_surnames_of_all_genders_are_told_apart(spark):
    def narrow(key, kind, normal, attempt):
        return pii.draw(key, kind, normal, attempt) if attempt else "барбаров"

    texts = ["г-н Аов", "г-жа Бова", "доктор Венко", "г-жа Барбарова"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cores = [r.core for r in pii.assign(pii.entities(docs), KEY, narrow).collect()]
    assert len(set(cores)) == 4 and "барбаров" not in cores


def test_further_notations(spark):
    found = {
        "to 2001:db8::1, x": "2001:db8::1", "fe80::1%eth0": "fe80::1", "at fe80:0:0:0:0:0:0:1.": "fe80:0:0:0:0:0:0:1", "net 2001:DB8:1::": "2001:DB8:1::",
        "call 555 123 4567.": "555 123 4567", "London 020 7946 0958": "020 7946 0958", "Berlin 030 1234567, x": "030 1234567", "030/1234567": "030/1234567", "Paris 06 12 34 56 78": "06 12 34 56 78",
        "password=correcthorse x": "correcthorse", "pwd=hunterhunter.": "hunterhunter",
    }
    kept = ["std::vector a::b dead::beef x", "100 200 3000", "555 123 4567 890", "0.123 45678", "12:30:45", "password: please ask", "password=getpass()", "in 2023 2024 2025", "1 555 123 4567 8", "05/2024-2025", "007 123"]
    got = replaced(spark, [*found, *kept])
    for (text, part), new in zip(found.items(), got.values()):
        before, after = text.split(part)
        assert new.startswith(before) and new.endswith(after) and part not in new, (text, new)
    assert list(got.values())[len(found):] == kept
    same = [got[k][len(a):].split("%")[0].split(".")[0] for k, a in ((1, ""), (2, "at "))]
    assert same[0] == same[1] and got[6].startswith("Berlin 0") and got[6][7:10] + got[6][11:18] == got[7][:3] + got[7][4:]
