"""Cards beside other numbers, and phone numbers without a country prefix."""

import re

from reachlight.llm import pii

CARD = "4539 1488 0343 6467"


def test_cards_beside_numbers(spark):
    bare = CARD.replace(" ", "")
    texts = [CARD, f"5 {bare}", f"id 12 {CARD}.", f"{CARD} 12", f"{bare} 42", f"7 8 {bare} 2020-01-31 {CARD} 9 x", "1 2 3 4 5 6 7 8 9 1 2 3 4 x", f"{CARD} 12-34-x", " ".join(["17"] * 300) + f" {CARD}"]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    new = got[0].text
    plain = new.replace(" ", "")
    assert new != CARD and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", new)
    assert [got[k].text for k in (1, 2, 3, 4, 7)] == [f"5 {plain}", f"id 12 {new}.", f"{new} 12", f"{plain} 42", f"{new} 12-34-x"]
    assert got[5].text.startswith(f"7 8 {plain} ") and got[5].text.endswith(f" {new} 9 x") and "2020-01-31" not in got[5].text
    assert (got[5].n_found, got[5].kinds) == (3, "card,date") and got[8].text.endswith(new)


def test_local_phones(spark):
    texts = ["call (555) 123-4567 now", "555-123-4567", "155-123-4567", "078-05-1120"]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    assert [got[k].kinds for k in range(4)] == ["phone", "phone", "", "ssn"] and "123-4567" not in got[0].text + got[1].text
