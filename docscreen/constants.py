"""Fixed values shared by the operators.

Everything in this module is data: word lists, lookup tables, patterns and
thresholds whose exact value decides the result.  Anything longer (role
requirements, large skill dictionaries) is read from files by
:mod:`docscreen.sources.dictionaries`.
"""

# --------------------------------------------------------------------------
# Character classes.  Spelled out because `\w` and `\s` are ASCII-only in Java
# while the semantics asked for are Unicode.
# --------------------------------------------------------------------------
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --------------------------------------------------------------------------
# Thresholds and proportions
# --------------------------------------------------------------------------
SEED = 42
SHORT_CHARS = 100
MIN_CLEAN_CHARS = 30
LONG_CHARS = 3000
MIN_TOKENS = 20
MIN_CLASS_ROWS = 3
TINY_CLASS_ROWS = 5
IMBALANCE_RATIO = 2.0
SNIPPET_CHARS = 200
LEAK_ROWS = 50
UNIFORM_STD = 2.0
BOILERPLATE_WINDOW = 60
BOILERPLATE_WINDOWS = 3
BOILERPLATE_PREFIX = 300
BOILERPLATE_SHARE = 0.70
NEAR_DUP_COSINE = 0.95
NEAR_DUP_FEATURES = 3000
NEAR_DUP_SAMPLE = 500
LSA_DIMENSIONS = 256
MAX_FEATURES_GRID = (10_000, 20_000, 30_000)
TFIDF_GRID = {
    "max_features": (3000, 5000, 10000),
    "ngram_range": ((1, 1), (1, 2)),
    "min_df": (1, 2),
    "max_df": (0.85, 0.95),
}
HOLDOUTS_70_15_15 = (("test", 0.15), ("validation", 0.15 / 0.85))
HOLDOUTS_80_20 = (("test", 0.20), ("validation", 0.20))
MAX_FILE_BYTES = 10 * 1024 * 1024
FILE_EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff")

# --------------------------------------------------------------------------
# Column aliases
# --------------------------------------------------------------------------
TEXT_ALIASES = ("resume_text", "resumetext", "resume", "text", "content")
LABEL_ALIASES = ("job_role", "jobrole", "category", "role", "label")

# --------------------------------------------------------------------------
# Patterns of the cleaning chain (T1), applied to lower case text
# --------------------------------------------------------------------------
URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
HTML_TAG = r"<[^>]+>"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
# The lookahead only tells the engine early where a match cannot begin.
PHONE = (
    rf"(?=[+(\p{{Nd}}]){BOUNDARY}(?:\+?\p{{Nd}}{{1,3}}[{SPACE}-]?)?"
    rf"(?:\(\p{{Nd}}{{2,4}}\)[{SPACE}-]?|\p{{Nd}}{{2,4}}[{SPACE}-])?"
    rf"\p{{Nd}}{{3,4}}[{SPACE}-]?\p{{Nd}}{{3,4}}{BOUNDARY}"
)
ADDRESS = (
    rf"(?i)(?=\p{{Nd}}){BOUNDARY}\p{{Nd}}{{1,5}}[{SPACE}]+(?:[A-Za-z0-9]+[{SPACE}]){{0,3}}"
    rf"(?:street|st|avenue|ave|road|rd|lane|ln|boulevard|blvd|way|court|ct){BOUNDARY}"
)
SPECIAL_CHARS = rf"[^{WORD}{SPACE}+#.&-]"

# --------------------------------------------------------------------------
# Patterns and words of the technical-token cleaner
# --------------------------------------------------------------------------
TECH_EMAIL = rf"[{WORD}.+-]+@[{WORD}-]+\.[{WORD}.]+"
TECH_PHONE = rf"\+?\p{{Nd}}[\p{{Nd}}{SPACE}.()-]{{7,}}\p{{Nd}}"
TECH_OTHER = rf"[^a-z0-9_{SPACE}]"
STOP_WORD_EXCEPTIONS = ("no", "not", "nor", "but", "up", "off", "out", "in", "on", "at", "to", "r")
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've now
d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't
wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# --------------------------------------------------------------------------
# First-line phrase -> label (J1); also the leakage phrases (L1-L3)
# --------------------------------------------------------------------------
LABEL_MAP = {
    "Project Design": "Civil/Environmental Engineer",
    "Relationship Building": "HR Manager",
    "Design Review": "Civil/Structural Engineer",
    "Supervision": "Construction Manager",
    "Technical Support": "IT Support Engineer",
    "Trade Marketing Executive": "Marketing Manager",
    "Apparel Sourcing": "Apparel Sourcing Manager",
    "Machine Learning Design": "Machine Learning Engineer",
    "Machinery Maintenance": "Maintenance Engineer",
    "Design Creation": "Mechanical Design Engineer",
    "Administrative Support": "Admin & Safety Officer",
    "Database Design & Development": "Database Administrator",
    "Hardware & Network Installation": "IT Infrastructure Engineer",
    "Mikrotik Router Configuration": "Network Engineer",
    "Mushak Forms Maintenance": "VAT & Finance Officer",
    "Internal Audit Assistance": "Internal Auditor",
    "Management Trainee": "Management Trainee",
    "15+ Years Banking Experience": "Bank Audit Officer",
    "Recruitment Coordination": "HR & Recruitment Specialist",
    "Digital Marketing Strategy": "Digital Marketing Manager",
    "Machine Learning Leadership": "Senior ML/NLP Engineer",
    "iOS Lifecycle": "iOS Developer",
    "Hardware & Software Installation": "IT Systems Admin",
    "Generative AI Development": "AI & Deep Learning Engineer",
    "Open-Source Technologies": "DevOps Engineer",
    "Data Platform Design": "Data Engineer",
    "Full Stack Development": "Full Stack Developer",
    "Application Development": "Software Engineer",
}

# --------------------------------------------------------------------------
# Leakage markers
# --------------------------------------------------------------------------
MARKER_HEAD = (
    rf"(?i)(?:^|\n)[{SPACE}]*(?:category|job[{SPACE}]+category|target[{SPACE}]+role|classification)"
    rf"[{SPACE}]*[:=-][{SPACE}]*$"
)
TEMPLATE_MARKERS = (
    rf"target role[{SPACE}]*:",
    rf"job role[{SPACE}]*:",
    r"responsibility block",
    r"machine learning design",
    r"data platform design",
)

# --------------------------------------------------------------------------
# Skills (K3, K4)
# --------------------------------------------------------------------------
EXTRA_SKILLS = (
    "c#", "ruby", "php", "go", "rust", "scala", "kotlin", "swift",
    "html5", "css3", "angular", "vue.js", "django", "flask", "spring boot",
    "postgresql", "mongodb", "redis", "elasticsearch", "cassandra",
    "aws", "azure", "gcp", "docker", "kubernetes", "jenkins", "git",
    "machine learning", "deep learning", "nlp", "computer vision",
    "pandas", "numpy", "scikit-learn", "tensorflow", "pytorch",
    "agile", "scrum", "jira", "confluence", "linux", "unix", "bash",
)
SKILL_DISPLAY = {
    "html5": "HTML5", "css3": "CSS3", "vue.js": "Vue.js",
    "postgresql": "PostgreSQL", "mongodb": "MongoDB",
    "aws": "AWS", "gcp": "GCP", "nlp": "NLP",
    "scikit-learn": "Scikit-learn", "tensorflow": "TensorFlow",
    "pytorch": "PyTorch", "jira": "Jira",
}
OPEN_ENDED_SKILLS = ("c++", "c#")
SKILL_ALIASES = {
    "Python": ["python"],
    "Java": ["java"],
    "C++": [r"c\+\+", "cpp"],
    "C#": ["c#"],
    "SQL": ["sql"],
    "JavaScript": ["javascript", "js"],
    "HTML": ["html"],
    "CSS": ["css"],
    "React": ["react"],
    "Node.js": [r"node\.js", "nodejs"],
    "Pandas": ["pandas"],
    "NumPy": ["numpy"],
    "TensorFlow": ["tensorflow"],
    "PyTorch": ["pytorch"],
    "Machine Learning": ["machine learning"],
    "Deep Learning": ["deep learning"],
    "Power BI": ["power bi"],
    "Tableau": ["tableau"],
    "AWS": ["aws", "amazon web services"],
    "Docker": ["docker"],
    "Git": ["git"],
    "R": ["r"],
    "Scala": ["scala"],
    "Spark": ["spark", "apache spark"],
    "Kubernetes": ["kubernetes", "k8s"],
    "MongoDB": ["mongodb"],
    "PostgreSQL": ["postgresql", "postgres"],
    "Linux": ["linux"],
    ".NET": [r"\.net"],
    "NLP": ["nlp", "natural language processing"],
}

# --------------------------------------------------------------------------
# Screening score (K6)
# --------------------------------------------------------------------------
WEIGHTS = {
    "role_match": 0.40,
    "skills_match": 0.40,
    "experience_match": 0.15,
    "education_match": 0.05,
}
CONFIDENCE_SCALE = 3.5
EXPERIENCE_WORDS = ("experience", "years", "worked", "managed")
EDUCATION_WORDS = (
    "bachelor", "master", "phd", "degree", "university", "b.tech", "b.sc", "b.e", "b.a",
)

# --------------------------------------------------------------------------
# Catalogue (J12, K8).  Category rules are tried in this order.
# --------------------------------------------------------------------------
CATALOGUE_RULES = (
    ("hr", ("hr", "human resources", "recruitment", "recruiter")),
    ("data", ("data scientist", "data science", "data analyst", "data analytics")),
    ("web", ("web developer", "frontend developer", "front end developer", "web designer")),
    ("python", ("python developer", "python engineer")),
    ("software", ("software developer", "software engineer", "full stack developer",
                  "full-stack developer")),
)
CATALOGUE_DEFAULT = "generic"
CATALOGUE = {
    "python": [
        ("Zoho", ["Python", "SQL", "Django", "Software Development"]),
        ("Freshworks", ["Python", "REST APIs", "Cloud", "Software Development"]),
        ("Razorpay", ["Python", "SQL", "REST APIs", "Data Analysis"]),
        ("Infosys", ["Python", "SQL", "Cloud", "Project Management"]),
        ("TCS", ["Python", "SQL", "Java", "Project Management"]),
        ("Accenture", ["Python", "Cloud", "Data Analysis", "Project Management"]),
    ],
    "data": [
        ("Tiger Analytics", ["Python", "Machine Learning", "Data Analysis", "SQL"]),
        ("Mu Sigma", ["Python", "Data Analysis", "SQL", "Statistics"]),
        ("Fractal Analytics", ["Python", "Machine Learning", "Data Science", "SQL"]),
        ("TCS", ["Python", "SQL", "Data Analysis", "Cloud"]),
        ("Accenture", ["Python", "Data Analysis", "Machine Learning", "Cloud"]),
        ("Deloitte", ["Data Analysis", "SQL", "Statistics", "Power BI"]),
    ],
    "software": [
        ("Zoho", ["Java", "Python", "SQL", "Software Development"]),
        ("Freshworks", ["Java", "Python", "REST APIs", "Cloud"]),
        ("Infosys", ["Java", "Python", "SQL", "Cloud"]),
        ("TCS", ["Java", "Python", "SQL", "Project Management"]),
        ("Wipro", ["Java", "Python", "Cloud", "Software Development"]),
        ("Accenture", ["Java", "Python", "Cloud", "REST APIs"]),
    ],
    "web": [
        ("Freshworks", ["JavaScript", "React", "HTML", "CSS"]),
        ("Zoho", ["JavaScript", "Python", "HTML", "CSS"]),
        ("Razorpay", ["JavaScript", "React", "REST APIs", "CSS"]),
        ("Infosys", ["JavaScript", "React", "HTML", "CSS"]),
        ("TCS", ["JavaScript", "HTML", "CSS", "Java"]),
        ("Accenture", ["JavaScript", "React", "Cloud", "REST APIs"]),
    ],
    "hr": [
        ("Zoho", ["Recruiting", "Employee Relations", "HRIS", "Human Resources"]),
        ("Freshworks", ["Recruiting", "Onboarding", "Communication", "Interviewing"]),
        ("TCS", ["Recruiting", "Employee Relations", "Communication", "Interviewing"]),
        ("Infosys", ["Recruiting", "Training", "Onboarding", "Human Resources"]),
        ("Deloitte", ["Recruiting", "HRIS", "Employee Relations", "Human Resources"]),
        ("Accenture", ["Recruiting", "Onboarding", "Training", "Communication"]),
    ],
    "generic": [
        ("Infosys", ["Problem Solving", "Communication", "Project Management"]),
        ("TCS", ["Problem Solving", "Communication", "Project Management"]),
        ("Wipro", ["Problem Solving", "Communication", "Leadership"]),
        ("Accenture", ["Problem Solving", "Communication", "Data Analysis"]),
        ("HCLTech", ["Problem Solving", "Communication", "Cloud"]),
        ("Tech Mahindra", ["Problem Solving", "Communication", "Customer Service"]),
    ],
}

# --------------------------------------------------------------------------
# Words looked for in misclassified snippets
# --------------------------------------------------------------------------
ERROR_WATCH_WORDS = ("python", "sql", "machine learning", "deep learning",
                     "java", "javascript", "docker", "aws", "data", "linux")
