from tidewright.llm import urls


def test_rare_and_deep_bad_branches_are_blocked(spark):
    """A bad branch of under 1 % of a large host, and branches that part at the sixth segment."""
    rows = [(i, f"http://hot.net/{'spam' if i < 20 else 'news'}/{i}") for i in range(4000)]
    rows += [(10_000 + i, f"http://deep.net/a/b/c/d/e/{'spam' if i % 2 else 'news'}/{i}") for i in range(100)]
    rows += [(20_000, "http://lone.net/" + "/".join(f"s{chr(97 + i % 26)}" for i in range(300)))]
    labels = [(i, i < 20) for i in range(4000)] + [(10_000 + i, i % 2 == 1) for i in range(100)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"),
                                            spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    assert len(got) == len(rows)
    assert {r.verdict for i, r in got.items() if i < 20} == {"block"} and got[0].template == "/spam/*"
    assert {r.verdict for i, r in got.items() if 20 <= i < 4000} == {"allow"}
    assert {(r.verdict, r.template.split("/")[6]) for i, r in got.items() if 10_000 <= i < 20_000} == {("block", "spam"), ("allow", "news")}
    assert got[20_000].template == "/" + "/".join("*" * 300)
