"""Checksum validators as Columns: TRUE promotes a match to score 1, FALSE drops it, NULL leaves it at its base score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.functions.columns import digit, digits, let, weighted


def _null() -> Column:
    return F.lit(None).cast("boolean")


def _sized(m: Column, n: int, body: Callable[[Column], Column]) -> Column:
    """body(digits), FALSE unless there are n digits."""
    return let(digits(m), lambda d: F.when(F.length(d) == n, body(d)).otherwise(False))


def _mod_check(m: Column, n: int, weights: list[int], check: Callable[[Column, Column], Column]) -> Column:
    return _sized(m, n, lambda d: let(weighted(d, weights), lambda s: check(s, d)))


def luhn(d: Column) -> Column:
    return F.call_function("luhn_check", d) & (F.length(d) >= 2)


def credit_card(m: Column) -> Column:
    return let(digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))


def iban(m: Column) -> Column:
    def body(s: Column) -> Column:
        moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
        rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))
        return F.when(F.length(s).between(15, 34), rest == 1).otherwise(False)

    return let(F.upper(F.regexp_replace(m, "[^0-9A-Za-z]", "")), body)


#: The Base58 alphabet.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


LIMBS = 40


def _base58_bytes(m: Column) -> Column:
    """Hex of the decoded bytes: base-256 limbs, lowest first, multiplied by 58 for each character; leading ones are zero bytes."""

    def step(limbs: Column, c: Column) -> Column:
        start = F.struct((F.position(c, F.lit(BASE58)) - 1).alias("carry"), F.array().cast("array<int>").alias("out"))

        def times(a: Column, x: Column) -> Column:
            return let(x * 58 + a["carry"], lambda v: F.struct(F.floor(v / 256).cast("int").alias("carry"), F.concat(a["out"], F.array((v % 256).cast("int"))).alias("out")))

        return F.aggregate(limbs, start, times, lambda a: a["out"])

    limbs = F.aggregate(F.split(m, ""), F.array_repeat(F.lit(0), LIMBS), step)
    number = F.regexp_replace(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(F.hex(x), 2, "0")), ""), "^(00)+", "")
    return F.concat(F.repeat(F.lit("00"), F.length(F.regexp_extract(m, "^1*", 0))), number)


def base58_check(m: Column) -> Column:
    """The last four bytes are the first four of the payload's double SHA-256."""

    def body(h: Column) -> Column:
        n = F.length(h)
        sum_of = F.sha2(F.unhex(F.sha2(F.unhex(F.substring(h, F.lit(1), n - 8)), 256)), 256)
        return F.when(n >= 10, F.upper(F.substring(sum_of, 1, 8)) == F.substring(h, n - 7, F.lit(8))).otherwise(False)

    return F.when(m.rlike(f"^[{BASE58}]+$"), let(_base58_bytes(m), body)).otherwise(False)


def crypto(m: Column) -> Column:
    """Ethereum and bech32 forms have no checksum here; the rest is Base58Check."""
    low = F.lower(m)
    return F.when(low.startswith("0x"), F.when(m.rlike("^0[xX][0-9a-fA-F]{40}$"), _null()).otherwise(False)).when(low.startswith("bc1") | low.startswith("ltc1"), _null()).otherwise(base58_check(m))


def us_ssn(m: Column) -> Column:
    return _sized(m, 9, lambda d: F.when(F.substring(d, 1, 3).isin("000", "666") | d.startswith("9") | (F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000"), False).otherwise(_null()))


def imei(m: Column) -> Column:
    return _sized(m, 15, luhn)


def vin(m: Column) -> Column:
    # fixed values: transliteration and weights
    letters, values = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
    weights = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]

    def body(s: Column) -> Column:
        rest = let(weighted(F.translate(s, letters, values), weights), lambda x: x % 11)
        check = F.substring(s, 9, 1)
        ok = let(rest, lambda r: F.when(r == 10, check == "X").otherwise(check == r.cast("string")))
        return F.when((F.length(s) != 17) | s.rlike("[IOQ]"), False).when(ok, True).when(F.substring(s, 1, 1).between("1", "5"), False).otherwise(_null())

    return let(F.upper(F.regexp_replace(m, "[^0-9A-Za-z]", "")), body)


def nhs(m: Column) -> Column:
    return _mod_check(m, 10, list(range(10, 1, -1)), lambda s, d: let(11 - s % 11, lambda c: F.when(c == 10, False).otherwise(F.when(c == 11, 0).otherwise(c) == digit(d, 9))))


# fixed values: check letters
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
HETU_LETTERS = "0123456789ABCDEFHJKLMNPRSTUVWXY"


def _alnum(m: Column) -> Column:
    return F.upper(F.regexp_replace(m, "[^0-9A-Za-z]", ""))


def _nif(s: Column) -> Column:
    n = F.substring(s, 1, 8)
    return F.when(~n.rlike("^[0-9]{8}$"), _null()).otherwise(F.substring(F.lit(NIF_LETTERS), n.try_cast("int") % 23 + 1, F.lit(1)) == F.substring(s, 9, 1))


def es_nif(m: Column) -> Column:
    return let(_alnum(m), lambda s: F.when(F.length(s) == 9, _nif(s)).otherwise(False))


def es_nie(m: Column) -> Column:
    return let(_alnum(m), lambda s: F.when((F.length(s) == 9) & F.substring(s, 1, 1).isin("X", "Y", "Z"), _nif(F.concat(F.translate(F.substring(s, 1, 1), "XYZ", "012"), F.substring(s, 2, 8)))).otherwise(False))


def pesel(m: Column) -> Column:
    return _mod_check(m, 11, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3], lambda s, d: (10 - s % 10) % 10 == digit(d, 10))


def sg_nric(m: Column) -> Column:
    def body(s: Column) -> Column:
        first = F.substring(s, 1, 1)
        rest = let(weighted(F.substring(s, 2, 7), [2, 7, 6, 5, 4, 3, 2]) + F.when(first.isin("T", "G"), 4).otherwise(0), lambda x: x % 11)
        table = F.when(first.isin("S", "T"), "JZIHGFEDCBA").otherwise("XWUTRQPNMLK")
        return F.when(s.rlike("^[STFG][0-9]{7}[A-Z]$"), F.substring(table, rest + 1, F.lit(1)) == F.substring(s, 9, 1)).otherwise(False)

    return let(F.upper(F.trim(m)), body)


def au_abn(m: Column) -> Column:
    # the first digit is lowered by one in an unsigned byte, so that 0 becomes 255
    return _mod_check(m, 11, [0, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19], lambda s, d: (s + 10 * F.when(digit(d, 0) == 0, 255).otherwise(digit(d, 0) - 1)) % 89 == 0)


def au_tfn(m: Column) -> Column:
    return _mod_check(m, 9, [1, 4, 3, 7, 5, 8, 6, 9, 10], lambda s, d: s % 11 == 0)


def aadhaar(m: Column) -> Column:
    """Verhoeff: the dihedral group of the pentagon, and powers of one permutation of the digits."""

    def product(a: int, b: int) -> int:
        return (a + b) % 5 if a < 5 and b < 5 else 5 + (a + b - 5) % 5 if a < 5 else 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5

    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([base[x] for x in rows[-1]])
    d = F.array(*[F.lit(product(a, b)) for a in range(10) for b in range(10)])
    p = F.array(*[F.lit(x) for row in rows for x in row])

    def body(s: Column) -> Column:
        state = F.struct(F.lit(0).alias("c"), F.lit(0).alias("i"))
        step = lambda a, x: F.struct(F.get(d, a["c"] * 10 + F.get(p, a["i"] % 8 * 10 + x.cast("int"))).alias("c"), (a["i"] + 1).alias("i"))
        return F.when(digit(s, 0) >= 2, F.aggregate(F.split(F.reverse(s), ""), state, step, lambda a: a["c"] == 0)).otherwise(False)

    return _sized(m, 12, body)


def fi_hetu(m: Column) -> Column:
    def body(s: Column) -> Column:
        n = F.concat(F.substring(s, 1, 6), F.substring(s, 8, 3)).try_cast("long")
        return F.when(s.rlike("^[0-9]{6}[-+A][0-9]{3}[0-9A-Z]$"), F.substring(F.lit(HETU_LETTERS), (n % 31 + 1).cast("int"), F.lit(1)) == F.substring(s, 11, 1)).otherwise(False)

    return let(F.upper(F.trim(m)), body)


def au_acn(m: Column) -> Column:
    return _mod_check(m, 9, [8, 7, 6, 5, 4, 3, 2, 1], lambda s, d: (10 - s % 10) % 10 == digit(d, 8))


def au_medicare(m: Column) -> Column:
    return _mod_check(m, 10, [1, 3, 7, 9, 1, 3, 7, 9], lambda s, d: digit(d, 0).between(2, 6) & (s % 10 == digit(d, 8)))


def it_vat(m: Column) -> Column:
    return _sized(m, 11, luhn)


def ca_sin(m: Column) -> Column:
    return _sized(m, 9, luhn)


def _mod11_tail(d: Column, n: int, weights: list[int]) -> Column:
    """The digit at place n against 11 minus the weighted sum's remainder, those below 2 giving 0."""
    return let(weighted(d, weights) % 11, lambda r: F.when(r < 2, 0).otherwise(11 - r)) == digit(d, n)


def br_cpf(m: Column) -> Column:
    return _sized(m, 11, lambda d: ~d.rlike(r"^(\d)\1+$") & _mod11_tail(d, 9, list(range(10, 1, -1))) & _mod11_tail(d, 10, list(range(11, 1, -1))))


def br_cnpj(m: Column) -> Column:
    one = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return _sized(m, 14, lambda d: ~d.rlike(r"^(\d)\1+$") & _mod11_tail(d, 12, one) & _mod11_tail(d, 13, [6, *one]))


def nl_bsn(m: Column) -> Column:
    return _mod_check(m, 9, [9, 8, 7, 6, 5, 4, 3, 2, -1], lambda s, d: s % 11 == 0)


def tr_tckn(m: Column) -> Column:
    def body(d: Column) -> Column:
        tenth = F.pmod(weighted(d, [7, -1, 7, -1, 7, -1, 7, -1, 7]), F.lit(10)) == digit(d, 9)
        return (digit(d, 0) != 0) & tenth & (weighted(d, [1] * 10) % 10 == digit(d, 10))

    return _sized(m, 11, body)


def be_nrn(m: Column) -> Column:
    def body(d: Column) -> Column:
        n, check = F.substring(d, 1, 9).cast("long"), F.substring(d, 10, 2).cast("long")
        return (check == 97 - n % 97) | (check == 97 - (n + 2_000_000_000) % 97)

    return _sized(m, 11, body)


def pt_nif(m: Column) -> Column:
    return _mod_check(m, 9, list(range(9, 1, -1)), lambda s, d: let(11 - s % 11, lambda c: F.when(c >= 10, 0).otherwise(c)) == digit(d, 8))


def cn_ric(m: Column) -> Column:
    weights = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]

    def body(s: Column) -> Column:
        check = let((12 - weighted(s, weights) % 11) % 11, lambda c: F.when(c == 10, "X").otherwise(c.cast("string")))
        return F.when(s.rlike("^[0-9]{17}[0-9X]$"), check == F.substring(s, 18, 1)).otherwise(False)

    return let(F.upper(F.regexp_replace(m, "[^0-9Xx]", "")), body)


def ru_snils(m: Column) -> Column:
    return _mod_check(m, 11, list(range(9, 0, -1)), lambda s, d: F.when(s % 101 == 100, 0).otherwise(s % 101) == F.substring(d, 10, 2).cast("int"))


def de_tax(m: Column) -> Column:
    def body(d: Column) -> Column:
        step = lambda p, x: let((x.cast("int") + p) % 10, lambda s: F.when(s == 0, 10).otherwise(s) * 2 % 11)
        return F.aggregate(F.slice(F.split(d, ""), 1, 10), F.lit(10), step, lambda p: (11 - p) % 10) == digit(d, 10)

    return _sized(m, 11, body)


def se_pnr(m: Column) -> Column:
    return let(digits(m), lambda d: let(F.when(F.length(d) == 12, F.substring(d, 3, 10)).otherwise(d), lambda e: F.when(F.length(e) == 10, luhn(e)).otherwise(False)))


def za_id(m: Column) -> Column:
    return _sized(m, 13, luhn)


def kr_rrn(m: Column) -> Column:
    return _mod_check(m, 13, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5], lambda s, d: (11 - s % 11) % 10 == digit(d, 12))


def tw_national_id(m: Column) -> Column:
    # fixed values: letters in the order of their codes from 10 on
    order = "ABCDEFGHJKLMNPQRSTUVXYWZIO"

    def body(s: Column) -> Column:
        code = F.position(F.substring(s, 1, 1), F.lit(order)) + 9
        total = let(code, lambda c: F.floor(c / 10) + c % 10 * 9) + weighted(F.substring(s, 2, 9), [8, 7, 6, 5, 4, 3, 2, 1, 1])
        return F.when(s.rlike("^[A-Z][0-9]{9}$"), total % 10 == 0).otherwise(False)

    return let(F.upper(F.trim(m)), body)


def cz_birth_number(m: Column) -> Column:
    def body(d: Column) -> Column:
        n = d.try_cast("long")
        ten = (n % 11 == 0) | ((F.floor(n / 10) % 11 == 10) & (n % 10 == 0))
        return F.when(F.length(d) == 9, _null()).when(F.length(d) == 10, ten).otherwise(False)

    return let(digits(m), body)


#: By the name that the catalogue uses.
VALIDATORS: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (
        credit_card, iban, crypto, us_ssn, imei, vin, nhs, es_nif, es_nie, pesel, sg_nric, au_abn, au_tfn, aadhaar, fi_hetu, au_acn, au_medicare, it_vat, ca_sin,
        br_cpf, br_cnpj, nl_bsn, tr_tckn, be_nrn, pt_nif, cn_ric, ru_snils, de_tax, se_pnr, za_id, kr_rrn, tw_national_id, cz_birth_number,
    )
}
