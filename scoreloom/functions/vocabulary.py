"""The feature vocabulary: name to type. A feature that is absent is not stated, which differs from zero. Fixed values."""

from __future__ import annotations

FEATURES: dict[str, str] = {
    "education.has_bachelor": "bool", "education.has_master": "bool",
    "academics.ug_cgpa": "number", "academics.ug_pct": "number", "academics.pg_cgpa": "number",
    "academics.class10_pct": "number", "academics.class12_pct": "number", "academics.active_backlogs": "int", "academics.coursework": "list",
    "coding.leetcode.total": "int", "coding.leetcode.easy": "int", "coding.leetcode.medium": "int", "coding.leetcode.hard": "int",
    "coding.codeforces.rating": "int", "coding.codechef.rating": "int",
    "projects.count": "int", "projects.quantified_count": "int", "projects.deployed_count": "int",
    "experience.internship_count": "int", "experience.internship_months": "number", "experience.fulltime_months": "number",
    "experience.product_company_count": "int", "experience.core_company_count": "int",
    "skills.list": "list", "skills.languages": "list", "skills.cs_fundamentals": "list", "languages.spoken": "list",
    "achievements.hackathon_participations": "int", "achievements.hackathon_wins": "int", "achievements.awards_count": "int",
    "achievements.leadership_count": "int", "achievements.service_count": "int",
    "certifications.count": "int", "certifications.recognized_count": "int",
    "publications.count": "int", "publications.peer_reviewed_count": "int", "research.experience_months": "number", "research.faculty_guided": "bool",
    "exam.gate.score": "number", "exam.gate.percentile": "number", "exam.gate.air": "int", "exam.gate.year": "int",
    "exam.upsc.stage": "int", "exam.upsc.attempts": "int", "exam.ssc_bank.stage": "int",
    "candidate.date_of_birth": "date", "contact.github": "bool", "contact.linkedin": "bool", "sop.word_count": "int", "sop.specificity": "number",
}
DERIVED: dict[str, str] = {
    "candidate.age": "number", "coding.leetcode.medium_hard_share": "number", "academics.ug_pct_est": "number", "experience.total_months": "number",
    "exam.gate.years_since": "int", "skills.count": "int", "academics.coursework_count": "int", "languages.spoken_count": "int",
}
FEATURES |= DERIVED


def register_feature(name: str, kind: str) -> None:
    """Adds a feature of the caller's own tables to the vocabulary."""
    if FEATURES.setdefault(name, kind) != kind:
        raise ValueError(f"{name} is already {FEATURES[name]}")
