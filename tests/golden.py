"""Twenty-eight fresh documents in seven categories, written from facts: what must be found in them, and a scorer of its own that says what they are worth."""

from __future__ import annotations

TODAY = (2026, 9, 22)
STRONG, AVERAGE, EDGE, WEAK = "strong", "average", "edge", "weak"
OTHER_SKILLS = ["React", "Docker", "AWS", "PostgreSQL", "Redis", "Git", "Linux", "Flask", "Kafka", "Pandas", "NumPy", "MySQL"]
CS = ["Data Structures", "Algorithms", "Operating Systems", "DBMS", "Computer Networks", "System Design"]


def case(category, tier, **facts):
    return {"category": category, "tier": tier, **facts}


ROLE = [("Northwind Labs", "May 2025", "Jul 2025", 3), ("Flipkart", "Jan 2025", "Mar 2025", 3), ("Atlassian", "May 2024", "Jul 2024", 3)]
FULL = [("Southwind Systems", "Aug 2023", "Jul 2024", 12)]
CASES = [
    case("tech_product_fulltime", STRONG, cgpa=9.1, leetcode=(640, 140, 390, 110), codeforces=1720, interns=ROLE, projects=[(1, 1), (1, 1), (1, 1), (1, 0)], languages=3, cs=5, other=8, hackathons=(3, 2), certs=(2, 0), github=1),
    case("tech_product_fulltime", EDGE, cgpa=8.2, leetcode=(410, 150, 210, 50), interns=ROLE[:2], projects=[(1, 1), (1, 0), (0, 1)], languages=3, cs=4, other=6, hackathons=(2, 1), certs=(1, 1), github=1),
    case("tech_product_fulltime", AVERAGE, cgpa=7.4, leetcode=(180, 90, 80, 10), interns=ROLE[:1], projects=[(1, 0), (0, 1)], languages=2, cs=3, other=4, hackathons=(1, 0), github=1),
    case("tech_product_fulltime", WEAK, cgpa=6.1, projects=[(0, 0)], languages=1, other=2, backlogs=2),
    case("tech_internship", STRONG, cgpa=9.3, leetcode=(360, 90, 210, 60), codeforces=1560, interns=ROLE[:1], projects=[(1, 1), (1, 1), (1, 1)], languages=3, cs=5, other=8, hackathons=(3, 1), certs=(2, 0), github=1),
    case("tech_internship", EDGE, cgpa=8.4, leetcode=(210, 80, 110, 20), projects=[(1, 1), (1, 0)], languages=3, cs=4, other=5, hackathons=(2, 0), github=1),
    case("tech_internship", AVERAGE, cgpa=7.6, leetcode=(90, 50, 35, 5), projects=[(1, 0), (0, 1)], languages=2, cs=3, other=4, github=1),
    case("tech_internship", WEAK, cgpa=5.9, projects=[(0, 0)], languages=1, other=1),
    case("govt_civil_services", STRONG, pct=84.0, c10=93.0, c12=91.4, upsc=3, service=3, leadership=3, awards=3, spoken=["English", "Hindi", "Tamil"], dob="14/03/1999"),
    case("govt_civil_services", EDGE, cgpa=8.1, c10=88.0, c12=84.0, upsc=2, service=2, leadership=2, awards=2, spoken=["English", "Hindi", "Odia"], dob="02/11/1997"),
    case("govt_civil_services", AVERAGE, pct=68.0, c10=80.0, c12=72.0, upsc=1, service=1, leadership=1, awards=1, spoken=["English", "Hindi"], dob="30/06/2000"),
    case("govt_civil_services", WEAK, pct=52.0, c10=55.0, c12=51.0, spoken=["Hindi"], dob="11/01/1990"),
    case("govt_ssc_banking", STRONG, pct=81.0, c10=92.0, c12=90.0, ssc=3, office=3, spoken=["English", "Hindi", "Marathi"], dob="19/08/2001"),
    case("govt_ssc_banking", EDGE, pct=74.0, c10=85.0, c12=80.0, ssc=2, office=2, spoken=["English", "Hindi"], dob="05/05/2002"),
    case("govt_ssc_banking", AVERAGE, pct=63.0, c10=74.0, c12=70.0, ssc=1, office=2, spoken=["English", "Hindi"], dob="09/09/2000"),
    case("govt_ssc_banking", WEAK, pct=49.0, c10=52.0, c12=50.0, office=0, other=0, spoken=["Hindi"], dob="21/12/1992"),
    case("higher_ed_mtech", STRONG, cgpa=9.2, gate=(845, 61, None, 2026), projects=[(1, 0), (0, 0), (1, 1)], coursework=6, pubs=[1, 1], research=[("Jan 2025", "Jun 2025", 6)]),
    case("higher_ed_mtech", EDGE, cgpa=8.5, gate=(742, 410, None, 2026), projects=[(1, 0), (0, 0)], coursework=4, pubs=[0]),
    case("higher_ed_mtech", AVERAGE, cgpa=7.7, gate=(598, 3100, None, 2025), projects=[(0, 0), (0, 0)], coursework=3),
    case("higher_ed_mtech", WEAK, cgpa=5.7, gate=(372, None, None, 2022), projects=[(0, 0)]),
    case("higher_ed_ms_phd_research", STRONG, cgpa=9.4, gate=(861, 44, None, 2026), projects=[(1, 0), (1, 0), (0, 0)], coursework=6, pubs=[1, 1, 0], research=[("Jan 2024", "Dec 2024", 12)], faculty=1),
    case("higher_ed_ms_phd_research", EDGE, cgpa=8.7, gate=(756, 300, None, 2026), projects=[(1, 0), (0, 0)], coursework=5, pubs=[1, 0], research=[("Jan 2025", "Jun 2025", 6)], faculty=1),
    case("higher_ed_ms_phd_research", AVERAGE, cgpa=8.0, gate=(640, 2100, None, 2026), projects=[(0, 0), (0, 0)], coursework=3, pubs=[0], research=[("May 2025", "Jul 2025", 3)]),
    case("higher_ed_ms_phd_research", WEAK, cgpa=5.8, projects=[(0, 0)]),
    case("psu_via_gate", STRONG, pct=86.0, c10=95.0, c12=94.0, gate=(921, 38, None, 2026), cores=[("NTPC", "May 2024", "Jun 2024", 2), ("BHEL", "May 2025", "Jun 2025", 2)], projects=[(1, 0), (0, 0)], dob="07/07/2003"),
    case("psu_via_gate", EDGE, pct=77.0, c10=90.0, c12=85.0, gate=(818, 240, None, 2026), cores=[("GAIL", "May 2025", "Jul 2025", 3)], projects=[(1, 0), (0, 0)], dob="16/02/2002"),
    case("psu_via_gate", AVERAGE, pct=69.0, c10=82.0, c12=76.0, gate=(708, 1400, None, 2026), interns=ROLE[:1], projects=[(0, 0)], dob="23/10/2001"),
    case("psu_via_gate", WEAK, pct=58.0, c10=66.0, c12=60.0, projects=[(0, 0)], dob="01/04/1998"),
]
for _k, _c in enumerate(CASES):
    _c["doc_id"] = _k + 1
UPSC = {1: "UPSC CSE 2024: cleared Prelims", 2: "UPSC CSE 2024: cleared Mains written stage", 3: "UPSC CSE 2024: attended the Interview at Delhi"}
SSC = {1: "SSC CGL 2024: qualified Tier-I", 2: "IBPS 2024: qualified Mains", 3: "SSC CGL 2024: reached document verification"}
OFFICE = ["MS Office", "Excel", "Tally"]
AWARDS = ["Gold medal in a quiz of the district", "Merit scholarship of the state", "Best paper award of the college"]
LEADS = ["Captain of the debate team", "Secretary of the science club", "Class representative for two years"]
SERVES = ["NSS unit of the college, two camps", "Blood donation drive in the town", "Volunteer at a night shelter"]


def text_of(c):
    """A document in one of three layouts, with headings, labels and bullets of its own."""
    style = c["doc_id"] % 3
    bullet, dash = ("- ", "• ", "* ")[style], (" - ", " – ", " to ")[style]
    out = [f"{('Asha', 'Bela', 'Chand', 'Devi')[c['doc_id'] % 4]} {('Example', 'Sample', 'Specimen')[style]}", f"person{c['doc_id']}@example.com | +91 98450 1{c['doc_id']:04d} | linkedin.com/in/person{c['doc_id']}" + (" | github.com/person" if c.get("github") else ""), ""]

    def section(title, rows):
        if rows:
            out.extend([(title.upper(), f"{title.upper()}:", title.upper())[style], *rows, ""])

    grade = f"CGPA: {c['cgpa']}/10" if "cgpa" in c else f"{c['pct']}%"
    school = [f"Class {('XII', '12', 'XII')[style]}, A School, 2019, {c['c12']}%", f"Class {('X', '10', 'X')[style]}, A School, 2017, {c['c10']}%"] if "c10" in c else []
    section("Education", [f"B.Tech in Some Engineering, A College, 2019{dash}2023, {grade}", *school, *([f"Active backlogs: {c['backlogs']}"] if "backlogs" in c else [])])
    roles = [(who, a, b) for who, a, b, _ in (*c.get("interns", []), *c.get("cores", []))]
    section("Internships", [x for who, a, b in roles for x in (f"Intern, {who}, {a}{dash}{b}", f"{bullet}Wrote things that others used and kept them in order")])
    section("Experience", [x for who, a, b, _ in c.get("jobs", []) for x in (f"Engineer, {who}, {a}{dash}{b}", f"{bullet}Looked after services of the house")])
    section("Research Experience", [x for a, b, _ in c.get("research", []) for x in (f"Research Assistant, Materials Lab, {a}{dash}{b}", f"{bullet}Measured samples under Prof. Rao" if c.get("faculty") else f"{bullet}Measured things by hand")])
    said = lambda measured, live: f"{bullet}Made it" + (" and cut the time of a run by 40%" if measured else " from scratch") + (", deployed for the college" if live else "")
    section("Projects", [x for n, (measured, live) in enumerate(c.get("projects", [])) for x in (f"Work {'ABCD'[n]}: a tool for the yard", said(measured, live))])
    languages = ["Python", "C++", "Java"][: c.get("languages", 0)]
    rows = [f"Languages: {', '.join(languages)}"] if languages else []
    rest = [*OFFICE[: c.get("office", 0)], *CS[: c.get("cs", 0)], *OTHER_SKILLS[: c.get("other", 0)]]
    section("Skills", rows + ([", ".join(rest)] if rest else []))
    if "leetcode" in c:
        total, easy, medium, hard = c["leetcode"]
        section("Coding Profiles", [f"LeetCode: {total} problems solved, easy: {easy}, medium: {medium}, hard: {hard}", *([f"Codeforces rating {c['codeforces']}"] if "codeforces" in c else [])])
    exams = []
    if "gate" in c:
        score, air, pct, year = c["gate"]
        exams.append(f"GATE {year} (ME): Score {score}" + (f" | AIR {air}" if air else ""))
    section("Competitive Exams", exams + [x for x in (UPSC.get(c.get("upsc")), SSC.get(c.get("ssc"))) if x])
    taken, won = c.get("hackathons", (0, 0))
    section("Achievements", [bullet + ("Winner of" if n < won else "Took part in") + f" the {'spring summer autumn'.split()[n]} Hackathon" for n in range(taken)] + [bullet + x for x in AWARDS[: c.get("awards", 0)]])
    section("Positions of Responsibility", [bullet + x for x in (*LEADS[: c.get("leadership", 0)], *SERVES[: c.get("service", 0)])])
    known, unknown = c.get("certs", (0, 0))
    section("Certifications", [bullet + x for x in ["AWS Certified Developer", "CompTIA Cable Technician"][:known] + ["Pottery for beginners"][:unknown]])
    section("Publications", [f"{bullet}On the flow of grain {n}, " + ("IEEE Conference on Flow" if p else "arXiv preprint") for n, p in enumerate(c.get("pubs", []))])
    section("Relevant Coursework", [", ".join(["Heat Transfer", "Fluid Flow", "Materials", "Machine Elements", "Vibration", "Optimisation"][: c["coursework"]])] if "coursework" in c else [])
    section("Languages", [", ".join(c["spoken"])] if "spoken" in c else [])
    section("Personal Details", [f"Date of Birth: {c['dob']}"] if "dob" in c else [])
    return "\n".join(out)


def features_of(c):
    """What a reader must find, by name; features that a document doesn't state are left out."""
    roles, projects = [*c.get("interns", []), *c.get("cores", [])], c.get("projects", [])
    entries = bool(roles or c.get("jobs") or c.get("research"))
    taken, won = c.get("hackathons", (0, 0))
    pubs, certs = c.get("pubs", []), c.get("certs", (0, 0))
    skills = [*["Python", "C++", "Java"][: c.get("languages", 0)], *OFFICE[: c.get("office", 0)], *CS[: c.get("cs", 0)], *OTHER_SKILLS[: c.get("other", 0)]]
    f = {
        "education.has_bachelor": True, "education.has_master": False, "projects.count": len(projects), "projects.quantified_count": sum(m for m, _ in projects), "projects.deployed_count": sum(x for _, x in projects),
        "experience.internship_count": len(roles), "experience.product_company_count": sum(r[0] in ("Flipkart", "Atlassian") for r in roles), "experience.core_company_count": len(c.get("cores", [])),
        "achievements.hackathon_participations": taken, "achievements.hackathon_wins": won, "achievements.awards_count": c.get("awards", 0), "achievements.leadership_count": c.get("leadership", 0), "achievements.service_count": c.get("service", 0),
        "certifications.count": sum(certs), "certifications.recognized_count": certs[0], "publications.count": len(pubs), "publications.peer_reviewed_count": sum(pubs), "research.faculty_guided": bool(c.get("faculty")),
        "contact.github": bool(c.get("github")), "contact.linkedin": True,
    }
    assert entries or not c.get("faculty")
    numbers = {"academics.ug_cgpa": "cgpa", "academics.ug_pct": "pct", "academics.class10_pct": "c10", "academics.class12_pct": "c12", "academics.active_backlogs": "backlogs", "coding.codeforces.rating": "codeforces", "exam.upsc.stage": "upsc", "exam.ssc_bank.stage": "ssc"}
    f |= {name: c[k] for name, k in numbers.items() if k in c}
    if "leetcode" in c:
        f |= dict(zip((f"coding.leetcode.{x}" for x in ("total", "easy", "medium", "hard")), c["leetcode"], strict=True))
    if "gate" in c:
        f |= {k: v for k, v in zip((f"exam.gate.{x}" for x in ("score", "air", "percentile", "year")), c["gate"], strict=True) if v is not None}
    if roles:
        f["experience.internship_months"] = sum(r[3] for r in roles)
    if c.get("research"):
        f["research.experience_months"] = sum(r[2] for r in c["research"])
    if "coursework" in c:
        f["academics.coursework"] = ["Heat Transfer", "Fluid Flow", "Materials", "Machine Elements", "Vibration", "Optimisation"][: c["coursework"]]
    if "spoken" in c:
        f["languages.spoken"] = c["spoken"]
    if skills:
        f |= {"skills.list": skills, "skills.languages": [s for s in skills if s in ("Python", "C++", "Java")], "skills.cs_fundamentals": [s for s in skills if s in CS]}
    if "dob" in c:
        d, m, y = c["dob"].split("/")
        f["candidate.date_of_birth"] = f"{y}-{m}-{d}"
    return f


def derived_of(f):
    """The derived features, by their definitions."""
    out = dict(f)
    if "coding.leetcode.total" in f:
        out["coding.leetcode.medium_hard_share"] = min(1, (f["coding.leetcode.medium"] + f["coding.leetcode.hard"]) / f["coding.leetcode.total"])
    if "academics.ug_pct" in f or "academics.ug_cgpa" in f:
        out["academics.ug_pct_est"] = f.get("academics.ug_pct", round(f.get("academics.ug_cgpa", 0) * 9.5, 1))
    if "experience.internship_months" in f:
        out["experience.total_months"] = f["experience.internship_months"]
    if "exam.gate.year" in f:
        out["exam.gate.years_since"] = TODAY[0] - f["exam.gate.year"]
    for name, own in (("skills.count", "skills.list"), ("academics.coursework_count", "academics.coursework"), ("languages.spoken_count", "languages.spoken")):
        if own in f:
            out[name] = len(f[own])
    if "candidate.date_of_birth" in f:
        y, m, d = map(int, f["candidate.date_of_birth"].split("-"))
        out["candidate.age"] = TODAY[0] - y - ((TODAY[1], TODAY[2]) < (m, d))
    return out


def value_of(rule, x):
    if rule.kind == "boolean":
        return rule.yes if x else rule.no
    if rule.kind == "match_count":
        x = sum(i.lower() in {v.lower() for v in rule.values} for i in x)
    elif isinstance(x, list):
        x = len(x)
    if rule.kind == "step":
        return max((y for least, y in rule.points if x >= least), default=rule.below)
    if x <= rule.points[0][0]:
        return rule.points[0][1]
    for (a, ya), (b, yb) in zip(rule.points, rule.points[1:], strict=False):
        if x <= b:
            return ya + (yb - ya) * (x - a) / (b - a)
    return rule.points[-1][1]


def score_of(category, f):
    """(strength, confidence, eligible) of features under a category: weighted means of signals, then of sub-scores."""
    subs, known = {}, 0.0
    for sub in category.subscores:
        top = low = 0.0
        for s in category.of(sub):
            got = [(value_of(t.rule, f[t.feature]), -k, f[t.feature]) for k, t in enumerate(s.terms) if t.feature in f]
            best = max(got, key=lambda g: g[:2], default=None)
            if best and best[2] not in (0, False, [], ""):
                known += category.nominal(s)
            if best or s.missing == "zero":
                top += s.weight * (round(best[0], 4) if best else 0.0)
                low += s.weight
        if low:
            subs[sub] = round(100 * top / low, 1)
    weight = sum(category.subscores[k] for k in subs)
    failed = False
    for g in category.gates:
        x = f.get(g.feature)
        if x is not None:
            failed |= g.level == "fail" and ((g.min is not None and x < g.min) or (g.max is not None and x > g.max) or (g.equals is not None and x != g.equals))
        else:
            failed |= g.missing == "fail"
    return round(sum(category.subscores[k] * v for k, v in subs.items()) / weight, 1) if weight else 0.0, round(known, 2), not failed
