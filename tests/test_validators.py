"""Known good and bad identifiers for each checksum: T promotes, F drops, N has no opinion."""

import pytest
from pyspark.sql import functions as F

from maskwell.functions.validators import VALIDATORS

VECTORS = """
credit_card|4111-1111-1111-1111|T
credit_card|1234-5678-9012-3456|F
credit_card|41111|F
iban|GB82 WEST 1234 5698 7654 32|T
iban|GB00 WEST 1234 5698 7654 32|F
imei|49-015420-323751-8|T
imei|490154203237519|F
vin|11111111111111111|T
vin|12111111111111111|F
vin|1M8GDM9AXKP042788|T
vin|1I111111111111111|F
crypto|1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2|T
crypto|1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3|F
crypto|0OIl|F
crypto|0x32Be343B94f860124dC4fEe278FDCBD38C102D88|N
crypto|0x1234|F
crypto|bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq|N
us_ssn|123-45-6789|N
us_ssn|078-05-0000|F
us_ssn|000-12-3456|F
us_ssn|12345|F
nhs|943 476 5919|T
nhs|943 476 5918|F
es_nif|12345678Z|T
es_nif|12345678A|F
es_nif|1234|F
pesel|44051401359|T
pesel|44051401358|F
sg_nric|S1234567D|T
sg_nric|S1234567A|F
sg_nric|Z1234567D|F
sg_nric|bad|F
au_abn|51 824 753 556|T
au_abn|51 824 753 557|F
au_tfn|123456782|T
au_tfn|123456783|F
aadhaar|999941057058|T
aadhaar|999941057059|F
fi_hetu|131052-308T|T
fi_hetu|131052-308U|F
fi_hetu|131052X308T|F
es_nie|X1234567L|T
es_nie|X1234567A|F
es_nie|A1234567L|F
es_nie|bad|F
au_acn|004 085 616|T
au_acn|004 085 617|F
au_medicare|2428778132|T
au_medicare|2428778142|F
au_medicare|9428778132|F
it_vat|12345670785|T
it_vat|12345670786|F
ca_sin|046 454 286|T
ca_sin|046 454 287|F
br_cpf|111.444.777-35|T
br_cpf|111.444.777-36|F
br_cpf|111.111.111-11|F
br_cnpj|11.222.333/0001-81|T
br_cnpj|11.222.333/0001-82|F
nl_bsn|111222333|T
nl_bsn|111222334|F
tr_tckn|10000000146|T
tr_tckn|10000000147|F
tr_tckn|00000000146|F
be_nrn|93051822361|T
be_nrn|93051822362|F
pt_nif|123456789|T
pt_nif|123456781|F
cn_ric|440524188001010014|T
cn_ric|440524188001010015|F
ru_snils|11223344595|T
ru_snils|11223344596|F
de_tax|86095742719|T
de_tax|86095742718|F
se_pnr|8112189876|T
se_pnr|8112189875|F
se_pnr|198112189876|T
za_id|8001015009087|T
za_id|8001015009088|F
kr_rrn|9412011234569|T
kr_rrn|9412011234568|F
tw_national_id|A123456789|T
tw_national_id|A123456788|F
tw_national_id|1123456789|F
tw_national_id|A12345|F
cz_birth_number|7801232340|T
cz_birth_number|780123/2340|T
cz_birth_number|7801232341|F
cz_birth_number|780123234|N
cz_birth_number|12|F
""".strip().splitlines()


@pytest.mark.parametrize("name", sorted(VALIDATORS))
def test_vectors(spark, name):
    own = [x.split("|")[1:] for x in VECTORS if x.startswith(name + "|")]
    assert own
    verdict = {"T": True, "F": False, "N": None}
    rows = spark.createDataFrame([(m, verdict[v]) for m, v in own] + [("", False)], "m string, e boolean")
    assert [(r.m, r.v) for r in rows.select("m", VALIDATORS[name](F.col("m")).alias("v")).collect()] == [(r.m, r.e) for r in rows.collect()]
