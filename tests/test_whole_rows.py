"""Queries over rows of every kind that their tables may hold."""

import __spark_entry__ as entry

Q = entry.queries()


def test_every_url_and_host(spark, tmp_path):
    rows = [
        (1, "r", "https://paypal.com@evil.test/", "evil.test"), (2, "r", "https://xn--pypal-4ve.test/", "xn--pypal-4ve.test"), (3, "r", "https://p\u0430ypal.test/", "p\u0430ypal.test"), (4, "r", "javascript:alert(1)", None),
        (5, "r", "http://[bad", None), (6, "r", "https://bit.ly/x", "bit.ly"), (7, "r", "https://a%2eb.test/", "a%2eb.test"), (8, "r", None, "a_b.www.shop.test."),
    ]
    spark.createDataFrame(rows, "url_id long, report_id string, url string, host string").write.parquet(f"{tmp_path}/urls.parquet")
    got = {(r.url, r.code) for r in Q["url_predicates"](spark, str(tmp_path)).collect()}
    assert got == {(rows[0][2], "URL_USERINFO"), (rows[1][2], "URL_IDN_HOST"), (rows[2][2], "URL_IDN_HOST"), (rows[3][2], "URL_DANGEROUS_SCHEME"), (rows[4][2], "URL_MALFORMED"), (rows[5][2], "URL_SHORTENER"), (rows[6][2], "URL_ENCODED_HOST")}
    orgs = {r.url_id: r.org for r in Q["org_domain"](spark, str(tmp_path)).collect()}
    assert len(orgs) == 8 and orgs[3] == "p\u0430ypal.test" and orgs[4] is None and orgs[8] == "shop.test"


def test_every_message_comes_back(spark, tmp_path):
    subjects = ["plain", "", None, "=?utf-8?B?bm8=?=", " edge ", "Gr\u00fc\u00dfe \u4f60\u597d", "two\r\nlines", "x", "\u00e9" * 300]
    senders = ["a@b.test", "O_Brien+x@B.test", None, "", "a-b@c.test", "a@b.test", "a@b.test", '"odd one"@b.test', "a@b.test"]
    rows = [(i, f"r{i}", x, a) for i, (x, a) in enumerate(zip(subjects, senders, strict=True))]
    spark.createDataFrame(rows, "delivery_id long, report_id string, subject string, from_address string").write.parquet(f"{tmp_path}/messages.parquet")
    spark.createDataFrame([(1, "r1", 1, "from a by b;\r\n now"), (2, "r1", 2, "from c by d; now"), (3, "r5", 1, None)], "hop_id long, report_id string, idx int, raw string").write.parquet(f"{tmp_path}/hops.parquet")
    got = {r.delivery_id: (r.subject, r.sender, r.hops) for r in Q["parse_round_trip"](spark, str(tmp_path)).collect()}
    want = ["a@b.test", "o_brien+x@b.test", None, None, "a-b@c.test", "a@b.test", "a@b.test", '"odd one"@b.test', "a@b.test"]
    assert got == {i: (x, a, 2 if i == 1 else 0) for i, (x, a) in enumerate(zip(subjects, want, strict=True))}
