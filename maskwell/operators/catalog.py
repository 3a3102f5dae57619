"""The predefined pattern recognizers, in the order of registration, which decides the last conflict ties."""

from __future__ import annotations

# Entity, recognizer, pattern name, regular expression, base score, validator, context words.
# fmt: off
PATTERNS = [
    ("CREDIT_CARD", "CreditCardRecognizer", "All Credit Cards (weak)", r"\b((4\d{3})|(5[0-5]\d{2})|(6\d{3})|(1\d{3})|(3\d{3}))[- ]?(\d{3,4})[- ]?(\d{3,4})[- ]?(\d{3,5})\b", 0.3, "credit_card", "credit, card, visa, mastercard, amex, discover, diners, maestro, jcb, cc, instapayment"),
    ("CRYPTO", "CryptoRecognizer", "Crypto (Base58 BTC/LTC)", r"\b[13LM][a-km-zA-HJ-NP-Z1-9]{25,39}\b", 0.5, "crypto", "wallet, btc, eth, ltc, bitcoin, ethereum, litecoin, crypto, address"),
    ("CRYPTO", "CryptoRecognizer", "Crypto (ETH)", r"\b0[xX][a-fA-F0-9]{40}\b", 0.5, "crypto", "wallet, btc, eth, ltc, bitcoin, ethereum, litecoin, crypto, address"),
    ("CRYPTO", "CryptoRecognizer", "Crypto (bech32 BTC/LTC)", r"\b(?:bc1|ltc1)[ac-hj-np-z02-9]{8,87}\b", 0.5, "crypto", "wallet, btc, eth, ltc, bitcoin, ethereum, litecoin, crypto, address"),
    ("EMAIL_ADDRESS", "EmailRecognizer", "Email (medium)", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", 0.5, None, "email, mail, e-mail"),
    ("IBAN_CODE", "IbanRecognizer", "IBAN Generic", r"(?i)\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}\b", 0.3, "iban", "iban, bank, account, transfer, swift"),
    ("IP_ADDRESS", "IpRecognizer", "IPv4", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\b", 0.6, None, "ip, address, ipv4, ipv6"),
    ("IP_ADDRESS", "IpRecognizer", "IPv6", r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b", 0.6, None, "ip, address, ipv4, ipv6"),
    ("MAC_ADDRESS", "MacRecognizer", "MAC", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", 0.7, None, "mac, address"),
    ("URL", "UrlRecognizer", "URL", r"(?:https?://|www\.)[A-Za-z0-9._~:/?#@!$&'()*+,;=%\-\[\]]+", 0.6, None, "url, link, website, site"),
    ("DATE_TIME", "DateRecognizer", "Numeric date", r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b", 0.6, None, "date, born, birthday, day, year"),
    ("DATE_TIME", "DateRecognizer", "ISO date", r"\b\d{4}-\d{2}-\d{2}\b", 0.6, None, "date, born, birthday, day, year"),
    ("IMEI", "ImeiRecognizer", "IMEI", r"\b\d{2}[-\s]?\d{6}[-\s]?\d{6}[-\s]?\d\b", 0.5, "imei", "imei, mobile device, handset, device serial, phone serial, serial number"),
    ("VIN", "VinRecognizer", "VIN", r"\b[A-HJ-NPR-Z0-9]{17}\b", 0.5, "vin", "vin, vehicle identification, vehicle identification number, chassis, chassis number, vehicle"),
    ("US_SSN", "UsSsnRecognizer", "SSN", r"\b[0-9]{3}[-. ]?[0-9]{2}[-. ]?[0-9]{4}\b", 0.4, "us_ssn", "social, security, ssn, ssns, ssid"),
    ("UK_NHS", "NhsRecognizer", "NHS", r"\b\d{3}[ -]?\d{3}[ -]?\d{4}\b", 0.3, "nhs", "nhs, health, national, service"),
    ("UK_NINO", "UkNinoRecognizer", "NINO", r"\b[ABCEGHJ-PRSTW-Z][ABCEGHJ-NPRSTW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b", 0.4, None, "national, insurance, nino, ni"),
    ("ES_NIF", "EsNifRecognizer", "NIF", r"\b\d{8}[A-HJ-NP-TV-Za-hj-np-tv-z]\b", 0.3, "es_nif", "nif, dni, documento, identidad"),
    ("ES_NIE", "EsNieRecognizer", "NIE", r"\b[XYZxyz]\d{7}[A-Za-z]\b", 0.3, "es_nie", "nie, extranjero, identidad"),
    ("PL_PESEL", "PlPeselRecognizer", "PESEL", r"\b\d{11}\b", 0.1, "pesel", "pesel"),
    ("SG_NRIC_FIN", "SgNricRecognizer", "NRIC", r"\b[STFGstfg]\d{7}[A-Za-z]\b", 0.3, "sg_nric", "nric, fin, identity"),
    ("SG_UEN", "SgUenRecognizer", "UEN", r"\b\d{8,9}[A-Za-z]\b", 0.3, None, "uen, entity, business"),
    ("AU_ABN", "AuAbnRecognizer", "ABN", r"\b\d{2} ?\d{3} ?\d{3} ?\d{3}\b", 0.1, "au_abn", "abn, australian, business, number"),
    ("AU_TFN", "AuTfnRecognizer", "TFN", r"\b\d{3} ?\d{3} ?\d{3}\b", 0.1, "au_tfn", "tfn, tax, file, number"),
    ("AU_ACN", "AuAcnRecognizer", "ACN", r"\b\d{3} ?\d{3} ?\d{3}\b", 0.1, "au_acn", "acn, company, australian"),
    ("AU_MEDICARE", "AuMedicareRecognizer", "Medicare", r"\b[2-6]\d{3} ?\d{5} ?\d\b", 0.1, "au_medicare", "medicare"),
    ("IN_AADHAAR", "InAadhaarRecognizer", "Aadhaar", r"\b[2-9]\d{3} ?\d{4} ?\d{4}\b", 0.1, "aadhaar", "aadhaar, uid, uidai"),
    ("IN_PAN", "InPanRecognizer", "PAN", r"\b[A-Za-z]{5}\d{4}[A-Za-z]\b", 0.3, None, "pan, permanent, account"),
    ("IN_VOTER", "InVoterRecognizer", "Voter ID", r"\b[A-Za-z]{3}\d{7}\b", 0.3, None, "voter, epic, election"),
    ("IN_PASSPORT", "InPassportRecognizer", "IN Passport", r"\b[A-Za-z]\d{7}\b", 0.3, None, "passport"),
    ("IN_VEHICLE_REGISTRATION", "InVehicleRegistrationRecognizer", "IN Vehicle", r"\b[A-Za-z]{2}\d{2}[A-Za-z]{1,2}\d{4}\b", 0.3, None, "vehicle, registration, number, plate"),
    ("IT_FISCAL_CODE", "ItFiscalCodeRecognizer", "CF", r"\b[A-Za-z]{6}\d{2}[A-Za-z]\d{2}[A-Za-z]\d{3}[A-Za-z]\b", 0.3, None, "codice, fiscale, fiscal, code"),
    ("IT_VAT_CODE", "ItVatRecognizer", "VAT", r"\b\d{11}\b", 0.1, "it_vat", "vat, iva, partita"),
    ("IT_DRIVER_LICENSE", "ItDriverLicenseRecognizer", "IT DL", r"\b[A-Za-z]{2}\d{7}[A-Za-z]\b", 0.3, None, "patente, driver, license, licence"),
    ("FI_PERSONAL_IDENTITY_CODE", "FiHetuRecognizer", "HETU", r"\b\d{6}[-+ABCDEFYXWVU]\d{3}[0-9A-Ya-y]\b", 0.3, "fi_hetu", "hetu, henkilotunnus, identity"),
    ("CA_SIN", "CaSinRecognizer", "SIN", r"\b\d{3} ?\d{3} ?\d{3}\b", 0.1, "ca_sin", "sin, social, insurance"),
    ("US_ITIN", "UsItinRecognizer", "ITIN", r"\b9\d{2}[- ]?\d{2}[- ]?\d{4}\b", 0.3, None, "itin, taxpayer, individual, tax"),
    ("US_PASSPORT", "UsPassportRecognizer", "US Passport", r"\b\d{9}\b", 0.05, None, "passport, travel, document"),
    ("US_DRIVER_LICENSE", "UsDriverLicenseRecognizer", "US DL", r"\b[A-Za-z]\d{6,12}\b", 0.3, None, "driver, license, licence, dl"),
    ("US_BANK_NUMBER", "UsBankRecognizer", "US Bank", r"\b\d{8,17}\b", 0.05, None, "bank, account, acct, routing, checking, savings"),
    ("BR_CPF", "BrCpfRecognizer", "CPF", r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", 0.1, "br_cpf", "cpf"),
    ("BR_CNPJ", "BrCnpjRecognizer", "CNPJ", r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b", 0.1, "br_cnpj", "cnpj"),
    ("NL_BSN", "NlBsnRecognizer", "BSN", r"\b\d{9}\b", 0.1, "nl_bsn", "bsn, burgerservicenummer"),
    ("TR_TCKN", "TrTcknRecognizer", "TCKN", r"\b[1-9]\d{10}\b", 0.1, "tr_tckn", "tc, kimlik, tckn"),
    ("BE_NRN", "BeNrnRecognizer", "NRN", r"\b\d{2}\.?\d{2}\.?\d{2}-?\d{3}\.?\d{2}\b", 0.1, "be_nrn", "rijksregister, niss, nrn"),
    ("PT_NIF", "PtNifRecognizer", "PT NIF", r"\b\d{9}\b", 0.1, "pt_nif", "nif, contribuinte"),
    ("CN_RIC", "CnRicRecognizer", "RIC", r"\b\d{17}[\dXx]\b", 0.1, "cn_ric", "身份证, id"),
    ("RU_SNILS", "RuSnilsRecognizer", "SNILS", r"\b\d{3}-?\d{3}-?\d{3} ?\d{2}\b", 0.1, "ru_snils", "снилс, snils"),
    ("DE_TAX_ID", "DeTaxRecognizer", "Steuer-ID", r"\b\d{11}\b", 0.05, "de_tax", "steuer, steueridentifikationsnummer, tax"),
    ("SE_PERSONNUMMER", "SePnrRecognizer", "Personnummer", r"\b\d{6}[-+]?\d{4}\b", 0.1, "se_pnr", "personnummer"),
    ("ZA_ID", "ZaIdRecognizer", "ZA ID", r"\b\d{13}\b", 0.1, "za_id", "id, identity"),
    ("KR_RRN", "KrRrnRecognizer", "RRN", r"\b\d{6}-?\d{7}\b", 0.1, "kr_rrn", "주민, rrn"),
    ("JP_MYNUMBER", "JpMyNumberRecognizer", "My Number", r"\b\d{4} ?\d{4} ?\d{4}\b", 0.1, None, "mynumber, 個人番号, マイナンバー"),
    ("MX_RFC", "MxRfcRecognizer", "RFC", r"\b[A-Za-z]{4}\d{6}[A-Za-z0-9]{3}\b", 0.3, None, "rfc"),
    ("MX_CURP", "MxCurpRecognizer", "CURP", r"\b[A-Za-z]{4}\d{6}[A-Za-z]{6}[A-Za-z0-9]\d\b", 0.3, None, "curp"),
    ("TW_NATIONAL_ID", "TwNationalIdRecognizer", "TW National ID", r"\b[A-Za-z][0-9]{9}\b", 0.3, "tw_national_id", "身分證, national id, id number, 統一證號"),
    ("CZ_BIRTH_NUMBER", "CzBirthNumberRecognizer", "Rodné číslo", r"\b\d{6}/?\d{3,4}\b", 0.1, "cz_birth_number", "rodné číslo, rc, birth number"),
    ("CA_POSTAL_CODE", "CaPostalCodeRecognizer", "CA Postal Code", r"(?i)\b[ABCEGHJ-NPR-TVXY]\d[ABCEGHJ-NPR-TV-Z] ?\d[ABCEGHJ-NPR-TV-Z]\d\b", 0.4, None, "postal code, postcode, zip, mailing, shipping, code postal, adresse, courrier, livraison"),
    ("ZA_COMPANY_REGISTRATION", "ZaCompanyRegistrationRecognizer", "ZA Company Reg", r"\b(?:19|20)\d{2}/\d{6}/\d{2}\b", 0.4, None, "cipc, company registration, registration number, close corporation"),
    ("ZA_VAT_NUMBER", "ZaVatRecognizer", "ZA VAT", r"\b4\d{9}\b", 0.1, None, "vat, vat number, sars, tax"),
]
# fmt: on
