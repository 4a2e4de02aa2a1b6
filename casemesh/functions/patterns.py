"""Recognizer registry: entity type, pattern, confidence and capture group as data."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

# --- Fixed values: character classes -----------------------------------------------------
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
DEVANAGARI = "ऀ-ॿ"
DEVANAGARI_LETTER = "ऀ-॥॰-ॿ"

#: A word edge before something that is a word character itself, and any word edge.
EDGE_BEFORE_WORD, EDGE = rf"(?<!{WORD})", rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_SURE_WORD = re.compile(r"(?:\(\?:|\()*(?:\[[A-Za-z0-9\\-]+\]|\\p\{Nd\}|[A-Za-z0-9])")


@cache
def spelled(regex: str) -> str:
    """``regex`` for Java with white space and word edges of every script, where it has them for ASCII alone.

    White space is what ``str.isspace`` accepts, a word character a letter, number or underscore.
    """
    def one(part: re.Match) -> str:
        token = part.group(0)
        if token.startswith("["):
            return token if token == r"[\s\S]" else token.replace(r"\s", SPACE[1:-1])
        if token == r"\b":
            return EDGE_BEFORE_WORD if _SURE_WORD.match(regex, part.end()) else EDGE
        return SPACE if token == r"\s" else token

    return re.sub(r"\[(?:\\.|[^\]\\])*\]|\\.", one, regex)


@dataclass(frozen=True)
class Recognizer:
    """One row of the registry.

    ``regex`` is as printed; ``java`` spells it out for texts of every script. With ``tail_group`` the span is capture group 1, which must end the match.
    ``needs`` is a literal every match contains; texts without it are skipped. ``starts`` is what every match starts with,
    looked for first as that is cheaper than the whole pattern. ``sql_regex`` is the spelling for engines without
    look-around, where it differs.
    """

    entity_type: str
    regex: str
    confidence: int
    tail_group: bool = False
    needs: str | None = None
    sql_regex: str | None = None
    starts: str | None = None

    @property
    def java(self) -> str:
        return f"(?={self.starts})(?:{spelled(self.regex)})" if self.starts else spelled(self.regex)


# --- Fixed values: personal-data patterns --------------------------------------------------
PHONE_ANYWHERE = (
    r"(?:\+91[\-\s]?)?[6-9]\p{Nd}{9}\b|"
    r"(?:\+91[\-\s]?)?[6-9]\p{Nd}{4}[\s\-]?[0-9]{5}\b|"
    r"(?:\+91[\-\s]?)?[6-9]\p{Nd}{2}[\s\-]?[0-9]{3}[\s\-]?[0-9]{4}\b|"
    r"\b\p{Nd}{3}[-.]\p{Nd}{3}[-.]\p{Nd}{4}\b"
)
EMAIL_RX = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"

AADHAAR = Recognizer("AADHAAR", r"\b[2-9]\p{Nd}{3}[ -]*\p{Nd}{4}[ -]*\p{Nd}{4}\b", 85, starts="[2-9]")
PAN = Recognizer("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 90, starts="[A-Z]{5}")
PAN_CONFUSED = Recognizer("PAN", r"\b[A-Z]{5}[ -]?[0-9OI]{4}[ -]?[A-Z]\b", 65, starts="[A-Z]{5}")
PHONE_AS_PRINTED = Recognizer("PHONE_NUMBER", PHONE_ANYWHERE, 85, starts=r"[+\p{Nd}]")
PHONE = Recognizer("PHONE_NUMBER", rf"(?<!\p{{Nd}})(?:{PHONE_ANYWHERE})", 85, starts=r"[+\p{Nd}]")
EMAIL = Recognizer("EMAIL_ADDRESS", EMAIL_RX, 95, needs="@")
MEDICAL = Recognizer(
    "MEDICAL_CONDITION",
    r"(?i)\b(?:gunshot\s+wound|lacerated\s+wound|incised\s+wound|contusion|abrasion|"
    r"fracture|haemorrhage|poisoning|asphyxia|stab\s+wound|burn\s+injury|grievous\s+hurt|"
    r"head\s+injury|strangulation|rigor\s+mortis|post-mortem|traumatic\s+shock|"
    r"subdural\s+haematoma|acute\s+trauma|blunt\s+force\s+trauma)\b",
    85, starts="[ABCFGHILPRSTabcfghilprst]")
PERSON_TITLED = Recognizer(
    "PERSON",
    r"(?i:(?:\b(?:Mr|Mrs|Ms|Miss|Shri|Smt|Dr|Prof|Advocate|Adv|Inspector|Sub-Inspector|SI|ASI|HC|Constable|"
    r"Officer|Witness|Suspect|Accused|Victim|Complainant)\b[\.\:\-\/]?\s+)+)"
    r"([A-Z][a-z]+(?:\s+(?![\p{L}\p{N}_]+\s*[:\-])[A-Z][a-z]+)*)\b",
    80, tail_group=True, starts="[ACDHIMOPSVWacdhimopsvw]")
PERSON_NAMED = Recognizer(
    "PERSON",
    r"(?i)\b(?:named|alias|identified\s+as|son\s+of|daughter\s+of|w/o|s/o|d/o)[\s\:\-]+"
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b",
    80, tail_group=True, starts="[ADINSWadinsw]")
PERSON_CAPTIONED = Recognizer(
    "PERSON",
    r"(?i)\b(?:Name|Complainant|Informant|Accused|Suspect|Victim)[\s\:\-\/\.]+(?:(?:Shri|Smt|Mr|Dr)\.?\s+)?"
    r"([A-Za-z]{3,}(?:\s+(?![\p{L}\p{N}_]+\s*[:\-])[A-Za-z]{2,}){1,4})\b",
    80, tail_group=True, starts="[ACINSVacinsv]")
PERSON_PARENT = Recognizer(
    "PERSON",
    r"(?i)\b(?:son\s+of|daughter\s+of|wife\s+of|s/o|w/o|d/o)[\s\:\-\.]*(?:LT\.?\s*)?"
    r"(?:Sh\.?|Smt\.?|Mr\.?|Dr\.?)?\s*"
    r"([A-Za-z]{3,}(?:\s+(?![\p{L}\p{N}_]+\s*[:\-])[A-Za-z]{2,}){1,4})\b",
    80, tail_group=True, starts="[DSWdsw]")

# --- Fixed values: identifier patterns -----------------------------------------------------
SERVICE_ID = Recognizer("GOVT_SERVICE_ID", r"\b[A-Z]{2,6}-[A-Z]{2,6}-\p{Nd}{2,6}\b", 80, starts="[A-Z]{2}")
ENROLLMENT = Recognizer("BAR_ENROLLMENT_NUMBER", r"\b[A-Z]{1,4}/\p{Nd}{1,6}/(?:19|20)\p{Nd}{2}\b", 85, starts="[A-Z]")

# --- Fixed values: rows standing in for a general detector's list -------------------------
IP_ADDRESS = Recognizer("IP_ADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 95, needs=".", starts="[0-9]")
CREDIT_CARD = Recognizer("CREDIT_CARD", r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b", 85, starts="[0-9]")
US_PHONE = Recognizer("PHONE_NUMBER", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", 75, needs="(")

LEGAL_RECOGNIZERS = (
    AADHAAR, PAN, PAN_CONFUSED, PHONE, EMAIL, MEDICAL,
    PERSON_TITLED, PERSON_NAMED, PERSON_CAPTIONED, PERSON_PARENT,
)
ID_RECOGNIZERS = (SERVICE_ID, ENROLLMENT)
PLAIN_RECOGNIZERS = (EMAIL, IP_ADDRESS, CREDIT_CARD, US_PHONE)
DEFAULT_RECOGNIZERS = LEGAL_RECOGNIZERS + (IP_ADDRESS, CREDIT_CARD, US_PHONE)

# --- Fixed values: text that must survive masking -------------------------------------------
ACT_NAMES = (
    r"Cr\.?\s?P\.?\s?C\.?|I\.?P\.?C\.?|B\.?N\.?S\.?S\.?|B\.?N\.?S\.?|B\.?S\.?A\.?"
    r"|P\.?O\.?C\.?S\.?O\.?|N\.?D\.?P\.?S\.?|P\.?M\.?L\.?A\.?|M\.?C\.?O\.?C\.?A\.?"
    r"|IT\s+Act|भा\.?दं\.?सं\.?"
)
SECTION_TOKEN = r"\p{Nd}{1,4}[A-Z]{0,2}(?:\([\p{L}\p{N}_]{1,3}\))?"
STATUTE_CITATION = (
    r"(?i)(?:Section\s*|Sec\.?\s*|धारा\s*|अधिनियम\s*|संहिता\s*|U/s\s*)?"
    rf"(?:{SECTION_TOKEN}(?:\s*[/,&]\s*{SECTION_TOKEN})*\s*)?"
    rf"(?:{ACT_NAMES})(?:\s*{SECTION_TOKEN})?"
)
FORM_CAPTION = (
    r"(?i)(?<![A-Za-z])(?:P\.\s?S\.?|F\.?I\.?R\.?\s*No\.?|S\.?\s?No\.?|G\.?D\.?\s*No\.?|District"
    r"|थाना|जिला|प्र\.?\s?सू\.?\s?रि\.?|दिनांक|समय|वर्ष|अधिनियम|धाराएँ|धाराएं)"
)
TRIM_CHARS = r"[ .,:;()\[\]|\-\t]"

# --- Fixed values: evidence for or against a detected name ----------------------------------
SCORED_TYPES = ("PERSON", "LOCATION", "ORGANIZATION", "MEDICAL_CONDITION")
CONSONANT_RUN = r"(?i)[bcdfghjklmnpqrstvwxz]{4,}"
HONORIFIC_BEFORE = (
    r"(?i)(?:Shri|Sri|Smt|Kum|Mr|Mrs|Ms|Dr|Inspector|Sub-?Inspector|SI|ASI|Constable|Advocate|Hon'?ble"
    r"|श्री|श्रीमती|कुमारी)\.?\s*$"
)
WORD_TRIM = r"[.,:;()\[\]|\-]"
SCORE_DEVANAGARI, SCORE_NO_VOWEL, SCORE_CONSONANTS, SCORE_DIGIT, SCORE_SHORT = -35, -30, -30, -20, -15
SCORE_HONORIFIC, SCORE_MULTIWORD = 12, 5
SCORE_MIN, SCORE_MAX = 5, 99

# --- Fixed values: registration-form patterns -----------------------------------------------
GLOSS = r"(?:\s*\([^()\n]{0,40}\))?"
TIME_VALUE = r"(?<![\p{Nd}:])([0-2]?[0-9]:[0-5][0-9])(?![\p{Nd}:])(\s*(?:hrs|nrs|am|pm|बजे))?"
REGISTRATION_ROW = r"(?i)Info[\p{L}\p{N}_]{0,8}\s+\S{0,3}c[\p{L}\p{N}_]{0,3}ved|सूचना[^\n|]{0,15}प्राप्त"
AFTER_REGISTRATION = (
    r"(?i)Diary|रोजनामचा|Type\s+of\s+Information|सूचना\s+का\s+प्रकार|Place\s+of\s+Occurrence|घटना\s*स्थल"
)
OCCURRENCE_TIME = (
    r"(?i)Time\s*(?:From|To|Period)|Ti[\p{L}\p{N}_]{1,2}\s+From|Perio?d|अवधि|समय\s*(?:से|तक)"
)
LABELLED_TIME = r"(?i)(?:Time|समय|वक्त)" + GLOSS + r"[:\s]*" + TIME_VALUE
ACTS = (
    ("BNS", r"(?i:BNS|Bharatiya\s+Nyaya\s+Sanhita|भारतीय\s*न्याय\s*संहिता|बी\.?एन\.?एस\.?)"),
    ("IPC", r"(?i:IPC|Indian\s+Penal\s+Code|भा\.?\s*दं\.?\s*(?:सं\.?|वि\.?)"
            r"|भा०\s*दं०\s*(?:सं०|वि०)|भारतीय\s*दंड\s*संहिता)"),
)
SECTION_NUMBER = r"(?<!\p{Nd})([1-9][0-9]{0,3})(\([0-9a-zA-Z]+\))?(?!\p{Nd})"
HEADED_SECTION = r"(?i)(?:Section/s|Sections|धाराएं|धाराएँ|धारा)[:\s]*([1-9][0-9]{1,2}(?:\([0-9a-zA-Z]+\))?)"
ACT_YEARS = (1800, 2100)
VALUE_TRIM = r"[ !:,\-|]"
FIR_NUMBER = (
    r"(?i)(?:FIR\s*N[oO0]\.?|एफ\.?आई\.?आर\.?\s*(?:सं\.?|संख्या|नं\.?)?"
    r"|प्रथम\s*सूचना\s*रिपोर्ट(?:\s*(?:सं\.?|संख्या))?|मु\.?\s*अ\.?\s*सं\.?|मु०\s*अ०\s*सं०?"
    r"|मुकदमा\s*अपराध\s*संख्या|अपराध\s*(?:सं\.?|संख्या))[^0-9\n]{0,40}([0-9]{1,12}(?:/[0-9]{2,4})?)"
)
DISTRICT = (
    r"(?i)(?:District|जिला|जनपद)" + GLOSS + r"[:\s]*([^|\n]+?)"
    r"(?=\s*\||\s*P\.?S\.?[:\s]|\s*Police\s+Station|\s*थाना|\s*कोतवाली|\s*Year|\s*वर्ष|\s*साल|$)"
)
POLICE_STATION = (
    r"(?i)(?:P\.?S\.?|Police\s+Station|थाना|कोतवाली)" + GLOSS + r"[:\s]*([^|\n]+?)"
    r"(?=\s*\||\s*Year|\s*वर्ष|\s*साल|\s*FIR|\s*मु\.?अ|\s*प्रथम|$)"
)
YEAR = r"(?i)(?:Year|वर्ष|साल)" + GLOSS + r"[:\s]*([12][09][0-9]{2})"
DATE = (
    r"(?i)(?:Date|दिनांक|तारीख)" + GLOSS
    + r"[:\s]*([0-3]?[0-9][\/\-\.][01]?[0-9][\/\-\.][12][09][0-9]{2})"
)
INFORMATION_TYPE = r"(?i)(?:Type\s+of\s+Information|सूचना\s+का\s+प्रकार)" + GLOSS + r"[:\s]*([^|\n]+)"
COMPLAINANT = (
    r"(?i)(?:Complainant\s*/\s*Informant|शिकायतकर्ता|वादी|सूचक|प्रार्थी)[\s\S]*?"
    r"(?:(?:\([a-zA-Z0-9]\)\s*)?(?:Name|(?:का\s*)?नाम))?[:\s]*"
    "([A-Zऀ-ॿ][a-zA-Zऀ-ॿ\\s\\.]+"
    r"(?:s\/o|w\/o|d\/o|पुत्र|आत्मज|सुपुत्र|पत्नी|पुत्री|श्री|Sh\.|LT\.)?[^\n|,\(\)]+)"
)
COMPLAINANT_CAPTION = (
    r"(?i)^(?:(?:\([a-zA-Z0-9]\)\s*)?Name|(?:का\s*)?नाम|वादी|शिकायतकर्ता|सूचक|प्रार्थी)\s*[:\s]*"
)
ADDRESS = r"(?i)(?:Address|पता|निवास|निवासी)[:\s]*([^|\n]+)"
PLACE_HINDI = r"(?i)(?:घटना\s*स्थल|घटनास्थल|घटना\s+का\s+स्थान|मौका\s+वारदात)[:\s]*([^|\n]+)"
PLACE_ENGLISH = (
    r"(?i)(?:Place\s+of\s+Occurrence)[\s\S]*?(?:Address[:\s]*|Addre[a-zA-Z\$]{1,3}[:\s]*)?"
    r"([^|\n]+(?:PARK|ROAD|STATION|DELHI|HARYANA|PANDAL)[^|\n]*)"
)
PLACE_CAPTION = (
    r"(?i)^(?:\([a-zA-Z0-9]\)\s*)?(?:Place\s+of\s+Occurrence|Direction\s+and\s+Distance|Address"
    r"|Addre[a-zA-Z\$]{1,3}|घटना\s*स्थल|घटना\s+का\s+स्थान)[:\s]*"
)
INCIDENT_HINDI = r"(?i)(?:घटना\s+का\s+विवरण|अपराध\s+का\s+विवरण|संक्षिप्त\s+विवरण)[:\s]*([^|\n]+)"
INCIDENT_PROPERTY = (
    r"(?i)(?:Description\s+of\s+Property|Particulars\s+of\s+properties\s+stolen|घटना\s+का\s+विवरण)[\s\S]*?"
    r"([A-Z0-9\s,]+(?:GOLD|JHARI|DIAMOND|CASH|MOBILE|VEHICLE)[^|\n]*)"
)
# (template, upper-cased markers, markers as printed), first match wins.
TEMPLATES = (
    ("Delhi Police FIR", ("DELHI", "BNS.S", "BHARATIYA NYAYA"), ()),
    ("Haryana Police FIR", ("HARYANA",), ("अम्बाला", "हिसार", "करनाल")),
    ("UP Police FIR", ("UTTAR PRADESH",), ("उत्तर प्रदेश", "मु.अ.सं", "मु०अ०सं०", "जनपद")),
)
DEFAULT_TEMPLATE = "Standard Indian Police FIR"

(STATUTE_CITATION, FORM_CAPTION, HONORIFIC_BEFORE, GLOSS, TIME_VALUE, REGISTRATION_ROW, AFTER_REGISTRATION, OCCURRENCE_TIME,
 LABELLED_TIME, SECTION_NUMBER, HEADED_SECTION, FIR_NUMBER, DISTRICT, POLICE_STATION, YEAR, DATE, INFORMATION_TYPE,
 COMPLAINANT, COMPLAINANT_CAPTION, ADDRESS, PLACE_HINDI, PLACE_ENGLISH, PLACE_CAPTION, INCIDENT_HINDI,
 INCIDENT_PROPERTY) = map(spelled, (
     STATUTE_CITATION, FORM_CAPTION, HONORIFIC_BEFORE, GLOSS, TIME_VALUE, REGISTRATION_ROW, AFTER_REGISTRATION, OCCURRENCE_TIME,
     LABELLED_TIME, SECTION_NUMBER, HEADED_SECTION, FIR_NUMBER, DISTRICT, POLICE_STATION, YEAR, DATE, INFORMATION_TYPE,
     COMPLAINANT, COMPLAINANT_CAPTION, ADDRESS, PLACE_HINDI, PLACE_ENGLISH, PLACE_CAPTION, INCIDENT_HINDI, INCIDENT_PROPERTY))
ACTS = tuple((name, spelled(rx)) for name, rx in ACTS)
CITATION = Recognizer(
    "CITATION", STATUTE_CITATION, 0,
    starts=r"[BCIMNPSUbcimnpsu\p{Nd}धअसभ])(?=\p{Nd}|[Ss][Ee]|[Uu]/|[Cc][Rr]|[Ii][.PpTt]|[Bb][.NnSs]|[Pp][.OoMm]|[Nn][.Dd]|[Mm][.Cc]|[धअसभ]")
CAPTION = Recognizer("CAPTION", FORM_CAPTION, 0, starts="[DFGPSdfgpsथजपदसवअध]")
DEVANAGARI_DIGITS, ASCII_DIGITS = "०१२३४५६७८९", "0123456789"
