import pytest

from tagloom.operators import units as U

P, T, F, D = U.FIELDS

CASES = [
    (P, "1802/1179 psi(g)", [12424, 8129]),
    (P, "35.3 / 258.5 bara", [3429, 25749]),
    (P, "1637 / 822,5 psi (a)", [11185, 5570]),
    (P, "F.V./10.5 kg/cm2(g)", [-101, 1030]),
    (P, "Full Vacuum & 9 bar g", [-101, 900]),
    (P, "FV", [-101]),
    (P, "lb/in2 g 45", [310]),
    (P, "265 kg/cm2(g)/19.5 BARA", [25988, 1849]),
    (P, "12'988 [kPa g]", [12988]),
    (P, "1 752 psi (a)/1,960 kPag/14.9 kg/cm²", [11978, 1960, 1461]),
    (P, "500 mbar(g)", [50]),
    (P, "10 barg (NOTE 3)", [1000]),
    (P, "150# Class", []),
    (P, "300#/150#", []),
    (P, "CLASS 600", []),
    (P, "see note 5", []),
    (P, "HOLD 3", []),
    (P, "ATM", []),
    (T, "419 & 163 ℃", [419, 163]),
    (T, "degF 732.2", [389]),
    (T, "-45  ℉ (RATED)", [-43]),
    (T, "−9 DEG. C", [-9]),
    (T, "10 - 20 / 30 deg C", [10, 20, 30]),
    (T, "10 to 20 / 30 C", [10, 20, 30]),
    (T, "361 °C/−53 deg F/305 degC", [361, -47, 305]),
    (T, "-20 - -10 ºC", [-20, -10]),
    (T, "300 K", [27]),
    (F, "1,372 kg/h", [1372]),
    (F, "4,15 M3/HR", [4]),
    (F, "cu.m/h 45", [45]),
    (F, "m3/h 250", [250]),
    (F, "12 345 US gpm", [2804]),
    (F, "3.2  klb/hr EACH", [1451]),
    (F, "5.5KG/S", [19800]),
    (F, "60 LPM", [4]),
    (D, "8 133 HP", [6065]),
    (D, "5,488,106 [watt]", [5488]),
    (D, "0.37 Gcal/h", [430]),
    (D, "H.P. 37", [28]),
    (D, "MMBtu/hr 9.9", [2901]),
    (D, "NOTE 7", []),
]


@pytest.mark.parametrize("field,text,want", CASES)
def test_values(field, text, want):
    assert [x for _, _, x in U._converted(field, text, None, None)] == want


def test_dimensions_are_vectors():
    assert U.expression("kg/h")[1] == U.RATE and U.expression("m3/h")[1] == U.FLOW and U.expression("kcal/h")[1] == U.POWER and U.expression("kgf/cm2")[1] == U.PRESSURE


def test_unit_of_last_resort(spark):
    items = [
        (1, 1, None, "10", "20", "30", "40", "x"),
        (2, 2, "PRESS: bar g, temperatures DEG F, flow rate klb/h, shaft duty in MW", "10", "50", "2", "1.5", "x"),
        (3, 1, "pump, relief valve set at 225 barg", "10", None, "", "-", "x"),
        (4, None, None, "10", "20 C", "5 kg/h", None, "x"),
        (5, 1, None, None, None, None, None, "x"),
        (6, 2, "Duty hp cooler", None, None, None, "7134", "x"),
        (7, 2, "duty hp, hp cooler", None, None, None, "100", "x"),
    ]
    df = spark.createDataFrame(items, "item_id long, source_id int, description string, design_pressure string, design_temperature string, flow_rate string, duty string, pressure_unit string")
    src = spark.createDataFrame([(1, "kPag", "degC", "m3/h", "hp"), (2, "psig", "degC", "kg/h", "kW")], "source_id int, pressure_unit string, temperature_unit string, flow_unit string, duty_unit string")
    got = {(r.item_id, r.field_name): (r.quantity_kind, r.whole_value) for r in U.normalise(df, src).collect()}
    assert got == {
        (1, "design_pressure"): ("pressure", 10), (1, "design_temperature"): ("temperature", 20), (1, "flow_rate"): ("volume_flow", 30), (1, "duty"): ("duty", 30),
        (2, "design_pressure"): ("pressure", 1000), (2, "design_temperature"): ("temperature", 10), (2, "flow_rate"): ("mass_flow", 907), (2, "duty"): ("duty", 1500),
        (3, "design_pressure"): ("pressure", 10), (4, "design_temperature"): ("temperature", 20), (4, "flow_rate"): ("mass_flow", 5),
        (6, "duty"): ("duty", 7134), (7, "duty"): ("duty", 75),
    }
    assert U.normalise(df.limit(0), src).count() == 0


def test_long_text_is_read_whole():
    assert len(U.read(P, " / ".join(["10 barg"] * 20_000))) == 20_000
