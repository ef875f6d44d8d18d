from tidewright.llm import pii


def test_words_on_either_side_of_lists(spark):
    """Every member of a list has the words of the list, and words after a span count."""
    one, two, three = "123-45-6788", "234-56-7891", "345-67-8912"
    key = ["0a" * 20, "1b" * 20, "2C" * 20]
    many = [f"{100 + i}-45-6788" for i in range(60)]
    cases = [
        (f"SSN: {one}, {two}, {three}", [one, two, three]), (f"ssn {one} and {two}", [one, two]), ("SSN " + "; ".join(many), many),
        (f"é🙂 {one} (SSN)", [one]), (f"{one}, {two} are social security numbers", [one, two]), (f"tokens: {' '.join(key)}", key),
        (f"{key[0]} is the password", [key[0]]), (f"part {one}, part {two}", []), (f"{one}{' x' * 25} ssn", []), (f"ssn {'x ' * 25}{one}", []),
        (f"ssn {'- ' * 30}{one}", []), (f"{one} ssn {two}", [one, two])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: [cases[r.doc_id][0][s.start:s.end] for s in r.spans if s.kind in ("ssn", "secret")] for r in pii.find(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[0] == "SSN: <SSN>, <SSN>, <SSN>" and masked[5] == "tokens: <SECRET> <SECRET> <SECRET>" and masked[3] == "é🙂 <SSN> (SSN)"
