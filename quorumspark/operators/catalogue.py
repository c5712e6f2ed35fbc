"""Fixed values of the document rules: patterns, keywords and their order."""

from __future__ import annotations

from collections.abc import Iterator

# Patterns of references to standards, in order; kind; the standard that a topic stands for.
REFERENCES = [
    (r"(?i)Standard\s*(\d{1,2})([a-z])?", "explicit", None),
    (r"\b(\d{1,2})\.([a-z])\b", "numeric", None),
    (r"(?i)Specification\s*([a-z])", "spec", None),
    (r"(?i)curriculum\s*matrix", "matrix", "11"),
    (r"(?i)field\s*(experience|placement)", "field", "21"),
    (r"(?i)faculty\s*credentials?", "faculty", "6"),
    (r"(?i)program\s*evaluation", "evaluation", "4"),
    (r"(?i)cultural\s*competenc", "cultural", "8"),
    (r"(?i)admission|retention|dismissal", "policies", "5"),
]

# Patterns of table types, in order.
TABLE_TYPES = {
    "curriculum_matrix": ["(?i)course", "(?i)standard", "[ITKS]", "[LMH]", r"(?i)CHS\s*\d+"],
    "grading_scale": ["(?i)grade", "(?i)percentage", "(?i)QPA|GPA", "[A-F][+-]?"],
    "schedule": ["(?i)week", "(?i)date", "(?i)topic", "(?i)assignment", "(?i)reading"],
    "course_list": ["(?i)course", "(?i)credit", "(?i)semester", "(?i)prerequisite"],
}

# Patterns of content types, in order.
CONTENT_TYPES = {
    "syllabus": [r"(?i)course\s*(description|objectives|outcomes)", r"(?i)grading\s*(scale|policy)", r"(?i)required\s*(text|reading)", r"(?i)class\s*schedule", r"(?i)instructor\s*information"],
    "cv": ["(?i)education", r"(?i)professional\s*experience", "(?i)publications", r"(?i)curriculum\s*vitae", r"(?i)employment\s*history"],
    "evaluation_form": ["(?i)evaluation", r"(?i)rating\s*scale", r"(?i)meets\s*expectations", r"(?i)below\s*expectations", r"(?i)exceeds\s*expectations"],
    "matrix": [r"(?i)curriculum\s*matrix", r"(?i)course\s*mapping", r"(?i)[ITKS]\s*[,/]\s*[LMH]"],
}

# Hints that a text is a curriculum matrix.
MATRIX_HINTS = [r"(?i)chs\s*\d{3}", r"(?i)[ITKS]\s*[,/]?\s*[LMH]", r"(?i)course\s*(code|number)", r"(?i)standard\s*\d+"]

# Lines that give a page's number, as "Page 3" or as the number alone.
PAGE_MARKER, PAGE_NUMBER = r"(?i)^page\s+\d+", r"^\d+\z"

# Kinds of lines, and lines in bold.
SECTION_HEADING = r"(?i)^(Standard\s*\d|Section\s*[IVX]+|Part\s*[IVX]+|Chapter\s*\d)"
LIST_ITEM = "^[•‣◦⁃∙\\-*]\\s|^\\d+[.)]\\s"
CAPITALS, CAPITAL, BOLD_LENGTH = r"^[A-Z\s]+\z", "^[A-Z]", 50

# What goes from a list's item, one after the other.
ITEM_MARKS = ["^[•‣◦⁃∙\\-*]\\s*", "^\\d+[.)]\\s*"]

# Headings by level, in order: pattern, level, and the length that a line must not reach (0: any).
HEADINGS = [
    (r"(?i)^(STANDARD|PART|CHAPTER|SECTION)\s+[IVXLCDM\d]+", 1, 0),
    (r"^[A-Z][A-Z\s\d:,\-]{10,}\z", 1, 100),
    (r"^\d+(\.\d+)?\s+[A-Z]", 2, 80),
    (r"^[a-zA-Z][.)]\s+|^\([a-zA-Z]\)\s+", 3, 0),
    (r"(?i)^Specification\s+[a-zA-Z]", 3, 0),
    (r"^[ivxIVX]+[.)]\s+", 4, 0),
]

# A titled line, the words that begin one, its level and the length that it must not reach.
TITLED = r"^[A-Z][a-zA-Z\s]+:?\s*\z"
HEADING_WORDS = r"(?i)^(Introduction|Overview|Background|Purpose|Objective|Mission|Vision|Goal|Summary|Conclusion|Recommendation|Discussion|Result|Method|Finding|Analysis|Assessment|Evaluation|Review)"
TITLED_LEVEL, TITLED_LENGTH = 2, 60

# Patterns of HTML: where sections begin, and their headings; tables, rows, cells and tags.
SECTION_START, SECTION_TITLE = r"(?i)(?=<h1[^>]*>)", r"(?i)^<h1[^>]*>(.*?)</h1>"
TABLE, ROW, CELL, TAG = r"(?is)<table[^>]*>.*?</table>", r"(?is)<tr[^>]*>.*?</tr>", r"(?is)<t[dh][^>]*>.*?</t[dh]>", "<[^>]*>"

# What tells a grading table and a schedule by their text, all of it needed.
GRADING = ["(?i)grade", "(?i)[A-F][+-]?", "(?i)percentage|points|qpa|gpa"]
SCHEDULE = ["(?i)week|date", "(?i)topic|theme|subject", "(?i)assignment|reading|due"]

# Code, part and title of each standard.
STANDARDS = [
    ("1", "I", "Program Identity"), ("2", "I", "Program Objectives"), ("3", "I", "Organizational Structure"), ("4", "I", "Budgetary Support"), ("5", "I", "Administrative Support"),
    ("6", "I", "Faculty"), ("7", "I", "Faculty Development"), ("8", "I", "Practicum/Field Experience Supervisors"), ("9", "I", "Student Services"), ("10", "I", "Admissions"),
    ("11", "II", "Curriculum"), ("12", "II", "Professional Practice"), ("13", "II", "Program Assessment"), ("14", "II", "Student Learning Outcomes"), ("15", "II", "Student Portfolio"),
    ("16", "II", "Program Advisory Committee"), ("17", "II", "Diversity"), ("18", "II", "Ethics"), ("19", "II", "Supervision"), ("20", "II", "Technology"), ("21", "II", "Field Experience"),
]

# The keywords of each standard (under ""), and of its specifications.
KEYWORDS = {
    "1": {"": ["institutional", "accredit", "program objective", "regionally accredited", "degree granting"], "a": ["regionally accredited", "accrediting body"], "b": ["degree-granting", "degree granting", "unit"], "c": ["primary objective", "human services"]},
    "2": {"": ["philosophical", "philosophy", "mission", "goals", "values"], "a": ["philosophical statement", "philosophy"], "b": ["program goals", "measurable"], "c": ["program mission", "institution mission"]},
    "3": {"": ["community assessment", "community needs", "labor market", "employment", "demand"], "a": ["assessment process", "community assessment"], "b": ["needs assessment", "community needs"], "c": ["labor market", "employment"]},
    "4": {"": ["program evaluation", "assessment", "outcomes", "continuous improvement"], "a": ["evaluation plan", "program outcomes"], "b": ["curriculum review", "continuous improvement"], "c": ["stakeholder feedback", "advisory"]},
    "5": {"": ["admission", "retention", "dismissal", "policies", "procedures", "students"], "a": ["admission criteria", "admission requirements"], "b": ["retention", "academic standing"], "c": ["dismissal", "termination"]},
    "6": {"": ["faculty", "credentials", "qualifications", "degree", "experience"], "a": ["master", "doctorate", "terminal degree"], "b": ["professional experience", "field experience"], "c": ["teaching experience", "instruction"]},
    "7": {"": ["personnel", "responsibilities", "evaluation", "job description", "faculty roles"], "a": ["job descriptions", "responsibilities"], "b": ["faculty evaluation", "performance review"], "c": ["professional development", "training"]},
    "8": {"": ["cultural competence", "diversity", "multicultural", "inclusion"], "a": ["cultural competence", "curriculum"], "b": ["diversity training", "cultural awareness"], "c": ["diverse populations", "underrepresented"]},
    "9": {"": ["program support", "resources", "budget", "facilities", "library"], "a": ["budget", "financial resources"], "b": ["facilities", "physical resources"], "c": ["library", "learning resources"], "d": ["technology", "computing"]},
    "10": {"": ["transfer", "credits", "prior learning", "articulation"], "a": ["transfer credits", "articulation"], "b": ["prior learning", "credit for experience"]},
    "11": {"": ["history", "historical", "human services history", "evolution"], "a": ["historical roots", "history of profession"], "b": ["legislative history", "policy history"]},
    "12": {"": ["human systems", "development", "family", "group dynamics", "organizational"], "a": ["human development", "lifespan"], "b": ["family dynamics", "family systems"], "c": ["group dynamics", "small group"], "d": ["organizational", "community systems"]},
    "13": {"": ["delivery systems", "service delivery", "agencies", "organizations"], "a": ["range of services", "service delivery"], "b": ["agency structure", "organization"], "c": ["funding sources", "resources"]},
    "14": {"": ["information literacy", "research", "data", "inquiry"], "a": ["research methods", "inquiry"], "b": ["information literacy", "resources"], "c": ["data analysis", "interpretation"]},
    "15": {"": ["planning", "evaluation", "program planning", "needs assessment"], "a": ["needs assessment", "client needs"], "b": ["treatment planning", "service planning"], "c": ["program evaluation", "outcome measurement"]},
    "16": {"": ["intervention", "strategies", "skills", "techniques", "counseling"], "a": ["interviewing", "intake"], "b": ["counseling strategies", "helping skills"], "c": ["case management", "coordination"], "d": ["crisis intervention", "emergency"]},
    "17": {"": ["communication", "interpersonal", "listening", "verbal", "nonverbal"], "a": ["verbal communication", "oral"], "b": ["written communication", "documentation"], "c": ["interpersonal skills", "relationships"]},
    "18": {"": ["administrative", "management", "supervision", "leadership"], "a": ["supervision", "staff"], "b": ["budgeting", "financial management"], "c": ["program management", "administration"]},
    "19": {"": ["values", "attitudes", "ethics", "client-related"], "a": ["ethical standards", "professional ethics"], "b": ["client dignity", "respect"], "c": ["confidentiality", "privacy"]},
    "20": {"": ["self-development", "self-awareness", "professional development", "growth"], "a": ["self-awareness", "personal values"], "b": ["professional growth", "continuing education"], "c": ["supervision", "feedback"]},
    "21": {"": ["field experience", "practicum", "internship", "field placement"], "a": ["field hours", "practicum hours"], "b": ["supervision", "field supervisor"], "c": ["learning objectives", "competencies"], "d": ["site selection", "placement sites"], "e": ["evaluation", "assessment"]},
}

#: Hundredths for each keyword found.
STANDARD_POINTS, SPECIFICATION_POINTS = 30, 20


def keywords() -> Iterator[tuple[str, str | None, str, int]]:
    """(standard, specification or null, keyword, points) in the order of the catalogue."""
    for standard, lists in KEYWORDS.items():
        for spec, words in lists.items():
            for word in words:
                yield standard, spec or None, word, SPECIFICATION_POINTS if spec else STANDARD_POINTS


def keyword_rows() -> str:
    """The catalogue as SQL rows of (standard, spec, keyword, points, place)."""
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join(f"('{s}', {quoted(p)}, '{k}', {n}, {i})" for i, (s, p, k, n) in enumerate(keywords()))
