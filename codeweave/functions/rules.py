"""Ordered rule tables and their columns. The tables are data: patterns, codes and labels are fixed values, first hit wins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (case-insensitive pattern searched in name, description, section and chapter; category; rationale).
KEYWORD_RULES = [
    (r"\bsurgical assist", "073.000", "Surgical assistance service"),
    (r"\bassistant.*surg", "073.000", "Surgical assistance service"),
    (r"\banaesth|anesthesia\b", "075.000", "Anaesthesia/anesthesia service"),
    (r"\bmajor consult", "001.000", "Major consultation"),
    (r"\bsurgical consult", "001.000", "Surgical consultation"),
    (r"\bconsult", "002.000", "Consultation service"),
    (r"\bgeneral assessment|general re.?assess", "003.000", "General/specific assessment"),
    (r"\bspecific assessment", "003.000", "Specific assessment"),
    (r"\bannual.*exam|annual health exam", "003.000", "Annual health exam"),
    (r"\bspecial eye|oculo.?visual|refraction", "009.000", "Special eye assessment"),
    (r"\bminor assess|partial assess|limited consult|repeat consult", "010.000", "Other/minor assessment"),
    (r"\bsubsequent.*visit|follow.?up", "010.000", "Subsequent office visit"),
    (r"\bhospital.*inpatient.*assess|inpatient.*assess", "005.000", "Hospital inpatient assessment"),
    (r"\bnewborn|premature.*baby|low birth weight", "004.000", "Newborn/premature care"),
    (r"\bhospital.*outpatient|outpatient.*visit", "006.000", "Hospital outpatient"),
    (r"\bhome.*visit|patient.*home", "021.000", "Home visit"),
    (r"\bspecial call|out.?of.?hours|out of hours|after.?hours|evening.*premium|night.*premium", "020.000", "Out-of-hours/special call"),
    (r"\bdetention", "016.000", "Detention"),
    (r"\bpalliative", "017.000", "Palliative care"),
    (r"\bindividual psycho|psychiatry|psychiatric", "022.000", "Individual psychiatry"),
    (r"\bgroup.*psycho|family.*psycho", "023.000", "Group/family psychiatry"),
    (r"\bcounsell?ing", "024.000", "Counselling"),
    (r"\bmastectomy|breast.*surg|breast.*excision", "025.000", "Mastectomy/breast surgery"),
    (r"\bbiopsy.*breast|breast.*biopsy|breast.*tumour|breast.*tumor", "026.000", "Breast tumor/biopsy"),
    (r"\bfracture|dislocation", "028.000", "Fracture/dislocation"),
    (r"\bdisc.*surg|vertebr|spinal.*canal|laminect", "029.000", "Disc/vertebrae surgery"),
    (r"\bhip.*arthroplasty|hip.*replac", "030.000", "Hip arthroplasty"),
    (r"\bknee.*arthroplasty|knee.*replac", "031.000", "Knee arthroplasty"),
    (r"\bcoronary.*bypass|cabg|bypass graft", "036.000", "Coronary artery bypass"),
    (r"\bangioplasty|percutaneous.*coronary", "037.000", "Coronary angioplasty"),
    (r"\belectrophysio|pacemaker|defibrillat|ablation", "038.000", "Cardiac electrophysiology"),
    (r"\bappendectomy|appendix", "043.000", "Appendectomy"),
    (r"\blaparotomy", "044.000", "Laparotomy"),
    (r"\bgallbladder|cholecyst|biliary", "045.000", "Gallbladder/biliary"),
    (r"\btonsil|adenoid", "046.000", "Tonsillectomy"),
    (r"\bhernia", "047.000", "Hernia"),
    (r"\bcolectomy|colon.*resect|intestin", "048.000", "Colon/intestines"),
    (r"\bhemorrhoid|proctotomy|rectum|anus", "049.000", "Rectum/hemorrhoidectomy"),
    (r"\bprostatectomy|prostate.*surg", "052.000", "Prostate surgery"),
    (r"\bvasectomy", "053.000", "Vasectomy"),
    (r"\bhysterectomy", "056.000", "Hysterectomy"),
    (r"\bsteriliz|tubal", "057.000", "Sterilization (female)"),
    (r"\bcaesarean|c.?section|obstetric", "059.000", "Caesarean section"),
    (r"\bcataract", "065.000", "Cataract surgery"),
    (r"\btonsillectomy", "046.000", "Tonsillectomy"),
    (r"\bnephrectomy|kidney.*surg", "051.000", "Urinary system surgery"),
    (r"\bx.?ray|radiograph|fluoroscop", "080.000", "X-ray/radiography"),
    (r"\bct scan|computed tomograph", "081.000", "CT scan"),
    (r"\bmri|magnetic resonance", "082.000", "MRI"),
    (r"\bultrasound|echograph", "083.000", "Ultrasound"),
    (r"\bnuclear.*med|scintigraph", "084.000", "Nuclear medicine imaging"),
    (r"\becg|electrocardiogram|electrocardiograph", "088.000", "ECG"),
    (r"\blab.*test|laboratory|blood test|urinalysis", "096.000", "Laboratory tests"),
    (r"\bphysio|physical.*ther|rehabilit", "077.000", "Rehabilitation/physiotherapy"),
    (r"\bpremium|surcharge|add.?on|\badd\b", "015.000", "Premium/add-on"),
]

#: Fixed values: (text contained in section and chapter, compared in upper case; category).
SECTION_RULES = [
    ("DETENTION", "016.000"), ("CONSULTATION", "002.000"), ("ASSESSMENT", "003.000"), ("ANAESTHESIA", "075.000"), ("OBSTETRIC", "059.000"),
    ("PAEDIATRIC", "003.000"), ("PSYCHIATRY", "022.000"), ("RADIOLOGY", "080.000"), ("PATHOLOGY", "096.000"), ("SURGERY", "032.000"),
    ("OPHTHALMOLOGY", "065.000"), ("CARDIOLOGY", "039.000"), ("DERMATOLOGY", "027.000"), ("NEUROLOGY", "032.000"),
    ("Out-of-Office", "020.000"), ("General Services", "010.000"), ("Diagnostic", "080.000"), ("Anaesthesiology", "075.000"), ("Obstetrics", "059.000"),
    ("Psychiatry", "022.000"), ("Radiology", "080.000"), ("Ophthalmology", "065.000"), ("Orthopaedics", "032.000"), ("Dermatology", "027.000"),
    ("Cardiology", "039.000"), ("Communication", "010.000"),
]

#: Fixed values: (text contained in an ON chapter heading without blanks, in upper case; chapter).
ON_CHAPTERS = [
    ("CONSULTATIONSANDVISITS", "A – Consultations and Visits"), ("NUCLEARMEDICINEINVIVO", "B – Nuclear Medicine In Vivo"), ("NUCLEARMEDICINEINVITRO", "C – Nuclear Medicine In Vitro"),
    ("DIAGNOSTICRADIOLOGY", "D – Diagnostic Radiology"), ("SPECIALPROCEDURES", "E – Special Procedures"), ("PHYSICIANSANAESTHESIA", "F – Anaesthesia"),
    ("GENERALSURGERY", "G – General Surgery"), ("DIGESTIVESYSTEM", "G – General Surgery"), ("OBSTETRICS", "H – Obstetrics"), ("PATHOLOGY", "J – Pathology"),
    ("OPHTHALMOLOGY", "K – Ophthalmology"), ("PSYCHIATRY", "L – Psychiatry"), ("PAEDIATRICS", "M – Paediatrics"), ("ORTHOPEDICSURGERY", "N – Orthopedic Surgery"),
    ("CARDIOTHORACICSURGERY", "P – Cardiothoracic Surgery"), ("NEUROSURGERY", "Q – Neurosurgery"), ("UROLOGY", "R – Urology"), ("MISCELLANEOUS", "S – Miscellaneous"),
    ("PREMIUMPAYMENTS", "T – Premiums"), ("PHYSICIANPROGRAMSERVICES", "U – Physician Program Services"), ("GENERALCONSIDERATIONS", "GP – General Preamble"),
    ("GENERALPREAMBLE", "GP – General Preamble"), ("SURGICALPREAMBLE", "G – General Surgery"), ("INTENSIVECORONARYCARE", "IC – Intensive/Coronary Care"),
    ("RADIATIONONCOLOGY", "X – Radiation Oncology"), ("ENDOCRINE", "G – General Surgery"), ("VASCULAR", "G – General Surgery"), ("THORACIC", "P – Cardiothoracic Surgery"),
    ("PLASTIC", "S – Miscellaneous"),
]

#: Chapters named in BC running headers, in order.
BC_CHAPTERS = [
    "General Services", "Diagnostic", "Surgery", "Obstetrics", "Anaesthesiology", "Ophthalmology", "Orthopaedics", "Psychiatry", "Radiology", "Out-of-Office", "Cardiology",
    "Neurology", "Urology", "Dermatology", "Paediatrics", "Gynaecology", "Pathology", "Physical Medicine", "Internal Medicine", "Ear", "Eyes",
]

#: Chapters that are renamed after parsing.
CHAPTER_NAMES = {
    "P": "P – Surgery", "IC": "IC – Intensive/Coronary Care", "I.C": "IC – Intensive/Coronary Care", "NOTALLOCATED": "Not Allocated", "APPENDIXF": "Appendix F", "WSIB": "WSIB",
    "RADIATIONONCOLOGY": "Radiation Oncology", "ENDOCRINESURGICALPROCEDURES": "Endocrine Surgical Procedures", "GENERALPREAMBLE": "GP – General Preamble",
}

#: Headings of the grouping document that name a province.
PROVINCE_HEADINGS = {
    "Newfoundland": "NL", "Prince Edward Island": "PE", "Nova Scotia": "NS", "New Brunswick": "NB", "Quebec": "QC", "Ontario": "ON", "Manitoba": "MB",
    "Saskatchewan": "SK", "Alberta": "AB", "British Columbia": "BC", "Yukon": "YT",
}


def first_hit(tests: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """CASE over (condition, value) in order."""
    none = F.lit(None) if otherwise is None else otherwise
    return reduce(lambda rest, t: F.when(t[0], t[1]).otherwise(rest), reversed(tests), none)


def required_literals(pattern: str) -> frozenset[str] | None:
    """Lower-case strings of which any text that the pattern matches has one, ignoring case; None if none can be told."""

    def of(items) -> frozenset[str] | None:
        found: list[frozenset[str]] = []
        run = ""
        for op, value in [*items, (None, None)]:
            if op is _parser.LITERAL:
                run += chr(value).lower()
                continue
            if run:
                found.append(frozenset([run]))
            run = ""
            inner = None
            if op is _parser.BRANCH:
                parts = [of(x) for x in value[1]]
                inner = None if None in parts else frozenset().union(*parts)
            elif op is _parser.SUBPATTERN:
                inner = of(value[3])
            elif op is _parser.MAX_REPEAT and value[0] > 0:
                inner = of(value[2])
            if inner:
                found.append(inner)
        return max(found, key=lambda x: min(map(len, x)), default=None)

    return of(_parser.parse(pattern))


def _folded(text: Column) -> Column:
    """The text in lower case, as the patterns compare: the four letters beyond ASCII that fold to one of ASCII count as that."""
    return F.lower(reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), [("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")], text))


def _worth_running(folded: Column, pattern: str) -> Column:
    literals = required_literals(pattern)
    return F.lit(True) if literals is None else reduce(lambda a, b: a | b, [folded.contains(x) for x in sorted(literals)])


def _of_folded(text: Column, make: Callable[[Column], Column]) -> Column:
    """make(folded text), which is computed once for all that is made of it."""
    return F.get(F.transform(F.array(_folded(text)), make), F.lit(0))


def _found(text: Column, folded: Column, pattern: str) -> Column:
    return _worth_running(folded, pattern) & text.rlike(f"(?iud){pattern}")


def first_rule(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Position from 1 of the first pattern found in the text, ignoring case; null if none is. A dot passes all but a line feed.

    Only patterns that have one of their required literals in the text are run.
    """
    return _of_folded(text, lambda folded: first_hit([(_found(text, folded, pattern), F.lit(i)) for i, (pattern, *_) in enumerate(rules, 1)], F.lit(None).cast("int")))


def patterns_run(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """How many patterns first_rule runs on the text."""
    hit = first_rule(text, rules)
    run = [F.when(_worth_running(_folded(text), pattern) & (F.lit(i) <= F.coalesce(hit, F.lit(len(rules)))), 1).otherwise(0) for i, (pattern, *_) in enumerate(rules, 1)]
    return reduce(lambda a, b: a + b, run)


def rule_field(position: Column, rules: list[tuple], field: int) -> Column:
    return F.try_element_at(F.array(*[F.lit(r[field]) for r in rules]), position)


def first_contained(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Value of the first rule whose key the text contains."""
    return first_hit([(text.contains(key), F.lit(value)) for key, value in rules], F.lit(None).cast("string"))


def section_category(section: Column, chapter: Column, rules: list[tuple[str, str]] = SECTION_RULES) -> Column:
    whole = F.upper(F.concat(F.coalesce(section, F.lit("")), F.lit(" "), F.coalesce(chapter, F.lit(""))))
    return first_contained(whole, [(key.upper(), value) for key, value in rules])


def on_chapter(heading: Column) -> Column:
    """The chapter of an ON heading; the heading itself, without blanks and in upper case, if no key is in it."""
    bare = F.upper(F.replace(heading, F.lit(" "), F.lit("")))
    return F.coalesce(first_contained(bare, ON_CHAPTERS), bare)


def renamed_chapter(chapter: Column) -> Column:
    bare = F.btrim(chapter)
    named = first_hit([(bare == key, F.lit(value)) for key, value in CHAPTER_NAMES.items()], bare)
    return F.when(named.rlike(r"^,?GP\d"), "GP – General Preamble").otherwise(named)
