from radiolith.functions.register import register


def test_functions_in_sql(spark):
    assert len(register(spark)) == 8
    row = spark.sql(r"select is_valid_tag('00100010'), is_valid_tag('0010001g'), is_private_tag('00091001'), join_tag(16, 16), canonical_private_key('00291008'), strip_pad('a \0 '), first_string(' a \\b'), first_string(''), decimal_string('1.5e2'), decimal_string('1d'), decimal_string('1e999'), integer_string('42'), integer_string('3.5')").first()
    assert list(row) == [True, False, True, "00100010", "0029XX08", "a", "a", None, 150.0, None, None, 42, None]
