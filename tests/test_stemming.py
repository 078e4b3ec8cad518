"""Stems against examples printed with the algorithm, in both engines."""

from __future__ import annotations

import duckdb

from covenant.functions.stemming import stemmed, stems_sql

#: Words and their stems. Fixed values.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll is is a a 2024 2024""".split()


def test_printed_examples(spark):
    pairs = dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    found = {r.word: r.stem for r in stemmed(spark.createDataFrame([(w,) for w in pairs], "word string")).collect()}
    assert found == pairs
    con = duckdb.connect()
    values = ", ".join(f"('{w}')" for w in pairs)
    assert dict(con.execute(f"WITH words(word) AS (VALUES {values}), {stems_sql('words')} SELECT * FROM stems").fetchall()) == pairs
