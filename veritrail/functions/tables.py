"""Names and word lists that results depend on."""

from __future__ import annotations

# List glyphs.
BULLETS = ("•", "▪", "◦", "‣", "-", "*", "·", "●", "–", "⁃")

# Headings by the section they open.
SECTION_HEADINGS = {
    "SUMMARY": ["SUMMARY", "PROFESSIONAL SUMMARY", "PROFILE", "OBJECTIVE", "CAREER OBJECTIVE", "ABOUT ME"],
    "EXPERIENCE": ["EXPERIENCE", "WORK EXPERIENCE", "PROFESSIONAL EXPERIENCE", "EMPLOYMENT HISTORY", "WORK HISTORY", "INTERNSHIPS", "RELEVANT EXPERIENCE"],
    "PROJECTS": ["PROJECTS", "PERSONAL PROJECTS", "ACADEMIC PROJECTS", "KEY PROJECTS", "SELECTED PROJECTS"],
    "EDUCATION": ["EDUCATION", "ACADEMIC BACKGROUND", "ACADEMICS", "EDUCATIONAL QUALIFICATIONS", "QUALIFICATIONS"],
    "SKILLS": ["SKILLS", "TECHNICAL SKILLS", "CORE COMPETENCIES", "KEY SKILLS", "SKILLS & TOOLS", "TECHNOLOGIES", "SKILLS SUMMARY", "TECHNICAL SKILLS SUMMARY", "SKILLS & INTERESTS"],
    "ACHIEVEMENTS": ["ACHIEVEMENTS", "HONORS", "AWARDS", "HONORS & AWARDS", "AWARDS & HONORS", "ACADEMIC ACHIEVEMENTS", "ACCOMPLISHMENTS"],
    "PUBLICATIONS": ["PUBLICATIONS", "RESEARCH PAPERS", "RESEARCH & PUBLICATIONS", "CONFERENCES", "RESEARCH"],
    "CERTIFICATIONS": ["CERTIFICATIONS", "CERTIFICATION", "LICENSES & CERTIFICATIONS", "COURSES"],
}
# Sections that hold several entries.
ENTRY_SECTIONS = ("EXPERIENCE", "EDUCATION", "PROJECTS", "PUBLICATIONS")
# The order of sections in a rebuilt document.
SECTION_ORDER = ("HEADER", "SUMMARY", "SKILLS", "EXPERIENCE", "PROJECTS", "EDUCATION", "CERTIFICATIONS", "ACHIEVEMENTS", "PUBLICATIONS", "OTHER")

# Words that retrieval ignores.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "of", "on", "or",
    "that", "the", "to", "was", "were", "will", "with", "this", "these", "those", "we", "our",
)

# The ladder of degrees.
DEGREES = ("unknown", "school", "diploma", "bachelor", "master", "doctorate")

# Skills and other ways to write them.
SKILLS = {
    "Python": ["python3", "python 3", "py", "python (pandas, asyncio)"],
    "Java": ["java 17", "core java", "java8", "java 8"],
    "JavaScript": ["js", "ecmascript", "vanilla js"],
    "TypeScript": ["ts"],
    "Go": ["golang"],
    "C++": ["cpp", "c plus plus"],
    "SQL": ["advanced sql", "sql queries", "structured query language"],
    "PostgreSQL": ["postgres", "psql", "postgresql (partitioning, indexing)"],
    "MySQL": [],
    "MongoDB": ["mongo", "document databases", "document databases (mongodb)"],
    "Redis": ["redis caching", "in-memory caching", "in-memory caching (redis)"],
    "Snowflake": [],
    "BigQuery": ["google bigquery"],
    "Machine Learning": ["ml", "applied ml", "ml modelling", "ml modeling"],
    "Deep Learning": ["dl", "neural networks", "neural nets"],
    "NLP": ["natural language processing", "text mining", "text analytics"],
    "PyTorch": ["torch", "pytorch (training & inference)", "pytorch lightning"],
    "TensorFlow": ["tf", "tf/keras", "tensorflow 2", "keras"],
    "Scikit-learn": ["sklearn", "scikit learn", "scikit-learn pipelines"],
    "Pandas": ["pandas / numpy", "pandas dataframes"],
    "NumPy": ["numpy vectorisation", "numpy vectorization"],
    "Statistics": ["statistical inference", "applied statistics", "stats"],
    "MLOps": ["ml platform engineering", "model deployment & monitoring", "model deployment and monitoring"],
    "Hugging Face": ["huggingface", "hugging face transformers", "transformers"],
    "Power BI": ["microsoft power bi", "powerbi", "power bi (dax)", "power bi / dax"],
    "Tableau": ["tableau desktop", "tableau dashboards"],
    "Looker": [],
    "Excel": ["advanced excel", "ms excel", "excel (pivot tables, power query)"],
    "Data Visualization": ["data viz", "dashboarding", "data visualisation"],
    "A/B Testing": ["ab testing", "split testing", "online experimentation"],
    "Experimentation": ["experiment design", "causal inference"],
    "ETL": ["data pipelines", "elt", "elt pipelines", "etl pipelines"],
    "REST APIs": ["rest", "restful services", "rest/http api design", "rest api", "restful apis"],
    "FastAPI": ["fastapi + pydantic", "async python apis", "async python apis (fastapi)"],
    "Node.js": ["nodejs", "node", "node (express)", "express"],
    "Docker": ["containerisation", "containerization", "containerisation (docker)", "docker & docker-compose", "docker compose"],
    "Kubernetes": ["k8s", "container orchestration", "container orchestration (kubernetes)"],
    "AWS": ["amazon web services", "ecs", "eks", "s3", "lambda"],
    "Azure": ["microsoft azure"],
    "GCP": ["google cloud", "google cloud platform"],
    "Microservices": ["microservice design", "service-oriented architecture", "soa"],
    "Message Queues": ["kafka", "rabbitmq", "async messaging", "kafka / rabbitmq"],
    "Git": ["git / github", "github", "version control", "version control (git)"],
    "CI/CD": ["ci", "cd", "jenkins", "github actions", "continuous integration"],
    "Unit Testing": ["pytest", "automated testing", "testing", "junit"],
}

# What a profile can lack.
NO_NAME, NO_WORK, NO_SKILLS, NO_DATES, NO_EDUCATION = "no name found", "no work experience found", "no skills found", "experience found but no usable dates", "no education found"


def skill_aliases() -> list[tuple[int, str, str]]:
    """(alias_pos, alias as written, canonical), a skill's own name before its aliases."""
    return [(k, alias, name) for k, (name, alias) in enumerate((name, alias) for name, aliases in SKILLS.items() for alias in (name, *aliases))]


def heading_aliases() -> list[tuple[str, str]]:
    return [(heading, section) for section, headings in SECTION_HEADINGS.items() for heading in headings]
