"""What fields, records and refusals are called: values that answers must show as they stand."""

from __future__ import annotations

#: Labels of the named fields and, for numbers, how the observed value and the target are said.
LABELS = {
    "years_experience": ("years of professional experience", "Candidate has {} years of professional experience", "{} years"),
    "role_count": ("number of roles listed", "Candidate lists {} roles", "{}"),
    "current_role_count": ("number of current roles", "Candidate holds {} current roles", "{}"),
    "total_role_months": ("total months across listed roles", "Candidate's listed roles total {} months", "{} months"),
    "longest_role_months": ("longest role in months", "Candidate's longest role lasted {} months", "{} months"),
    "shortest_role_months": ("shortest role in months", "Candidate's shortest role lasted {} months", "{} months"),
    "average_role_months": ("average role length in months", "Candidate's roles average {} months", "{} months"),
    "current_role_months": ("months in the current role", "Candidate has {} months in the current role", "{} months"),
    "latest_role_months": ("months in the latest role", "Candidate's latest role lasted {} months", "{} months"),
    "leadership_role_count": ("number of leadership roles", "Candidate lists {} leadership roles", "{}"),
    "contract_role_count": ("number of contract roles", "Candidate lists {} contract roles", "{}"),
    "permanent_role_count": ("number of permanent roles", "Candidate lists {} permanent roles", "{}"),
    "management_years": ("years managing people", "Candidate has {} years managing people", "{} years"),
    "people_managed_max": ("largest team led", "Candidate has led a team of {}", "{}"),
    "seniority_level": ("seniority level (0 intern - 10 executive)", "Candidate's highest seniority is level {}", "level {}"),
    "industry_count": ("number of industries worked in", "Candidate has worked in {} industries", "{}"),
    "aqf": ("highest qualification (AQF level)", "Candidate's highest qualification is AQF level {}", "AQF level {}"),
    "qualification_count": ("number of qualifications", "Candidate lists {} qualifications", "{}"),
    "degree_count": ("number of degrees (AQF 7+)", "Candidate holds {} degrees", "{}"),
    "publications_count": ("number of publications", "Candidate lists {} publications", "{}"),
    "skill_count": ("number of skills", "Candidate lists {} skills", "{}"),
    "technical_skill_count": ("number of technical skills", "Candidate lists {} technical skills", "{}"),
    "max_skill_years": ("most years with any one skill", "Candidate's deepest skill has {} years", "{} years"),
    "certification_count": ("number of certifications", "Candidate holds {} certifications", "{}"),
    "licence_count": ("number of licences", "Candidate holds {} licences", "{}"),
    "language_count": ("number of languages", "Candidate lists {} languages", "{}"),
    "project_count": ("number of projects", "Candidate lists {} projects", "{}"),
    "technology_count": ("number of technologies", "Candidate names {} technologies", "{}"),
    "availability_weeks": ("notice period in weeks", "Candidate's notice period is {} weeks", "{} weeks"),
    "skills": ("skills",),
    "technical_skills": ("technical skills",),
    "tool_skills": ("tools",),
    "domain_skills": ("domain skills",),
    "soft_skills": ("soft skills",),
    "language_skills": ("language skills",),
    "expert_skills": ("skills at advanced or expert level",),
    "skills_with_years": ("skills with a stated duration",),
    "technologies": ("technologies",),
    "languages": ("languages",),
    "certifications": ("certifications",),
    "licences": ("licences",),
    "role_titles": ("role titles",),
    "current_role_titles": ("current role titles",),
    "employers": ("employers",),
    "industries": ("industries",),
    "employment_types": ("employment types",),
    "seniorities": ("seniority levels held",),
    "qualification_titles": ("qualification titles",),
    "fields_of_study": ("fields of study",),
    "aqf_labels": ("AQF labels",),
    "project_names": ("project names",),
    "project_technologies": ("project technologies",),
    "current_role_title": ("current role title",),
    "latest_role_title": ("latest role title",),
    "highest_qualification": ("highest qualification",),
    "security_clearance": ("security clearance",),
    "work_rights": ("work rights status",),
    "highest_seniority": ("highest seniority held",),
    "latest_seniority": ("seniority of the latest role",),
    "latest_employment_type": ("employment type of the latest role",),
    "has_current_role": ("a current role",),
    "has_degree": ("a degree (AQF 7+)",),
    "has_postgraduate": ("a postgraduate award (AQF 8+)",),
    "has_masters": ("a masters (AQF 9+)",),
    "has_doctorate": ("a doctorate (AQF 10)",),
    "has_certifications": ("certifications",),
    "has_licence": ("a licence",),
    "has_clearance": ("a security clearance",),
    "has_management_experience": ("management experience",),
    "has_projects": ("listed projects",),
    "has_publications": ("publications",),
    "multilingual": ("two or more languages",),
    "work_rights_unrestricted": ("unrestricted work rights",),
    "requires_sponsorship": ("a sponsorship requirement",),
}

#: Fields of records, with their kinds, labels and phrasings.
RECORD_FIELDS = {
    "skill": {
        "name": ("text", "skill name"),
        "category": ("enum", "skill category"),
        "years": ("number", "years using the skill", "{} years with the skill", "{} years"),
        "proficiency": ("enum", "stated proficiency"),
        "evidence": ("text", "evidence for the skill"),
    },
    "role": {
        "title": ("text", "role title"),
        "employer": ("text", "employer"),
        "months": ("number", "months in the role", "{} months in the role", "{} months"),
        "is_current": ("flag", "currently held"),
        "seniority": ("enum", "seniority"),
        "industry": ("text", "industry"),
        "employment_type": ("enum", "employment type"),
        "team_size": ("number", "team size led", "led a team of {}", "{}"),
        "technologies": ("list", "technologies used"),
        "summary": ("text", "role summary"),
    },
    "qualification": {
        "title": ("text", "qualification title"),
        "field_of_study": ("text", "field of study"),
        "aqf": ("number", "AQF level", "AQF level {}", "AQF level {}"),
        "aqf_label": ("text", "AQF label"),
    },
    "project": {
        "name": ("text", "project name"),
        "summary": ("text", "project summary"),
        "technologies": ("list", "technologies used"),
        "months": ("number", "months on the project", "{} months on the project", "{} months"),
    },
}

#: Other names of records.
RECORD_ALIASES = {
    "skills": "skill", "roles": "role", "experience": "role", "job": "role", "jobs": "role", "position": "role", "positions": "role", "employment": "role",
    "qualifications": "qualification", "degree": "qualification", "degrees": "qualification", "education": "qualification", "award": "qualification", "projects": "project",
}

#: The statutes that reasons cite.
STATUTES = {
    "RDA_1975": "Racial Discrimination Act 1975 (Cth) ss 9, 15 — race, colour, national or ethnic origin",
    "FWA_351": "Fair Work Act 2009 (Cth) s 351 — adverse action on a protected attribute",
    "SDA_1984": "Sex Discrimination Act 1984 (Cth) ss 5, 7A, 14 — sex, pregnancy, family responsibilities",
    "ADA_2004": "Age Discrimination Act 2004 (Cth) ss 14, 18 — age",
    "DDA_1992": "Disability Discrimination Act 1992 (Cth) ss 5, 15 — disability",
    "ADA_QLD_1991": "Anti-Discrimination Act 1991 (Qld) ss 7, 14, 15 — protected attributes in work",
    "PRIVACY_1988": "Privacy Act 1988 (Cth) — collection limited to what is reasonably necessary",
}

_NO_FIELD = "Not a screening field."

#: Names that no rule may read: why, the statutes, and what to ask instead.
FORBIDDEN = {
    "region": ("location is a proxy for race and social origin; suburb and region correlate strongly with ethnicity and socio-economic background", ("RDA_1975", "ADA_QLD_1991"), "State the attendance requirement in the role description; it is not a screening field."),
    "suburb": ("location is a proxy for race and social origin", ("RDA_1975", "ADA_QLD_1991"), _NO_FIELD),
    "postcode": ("location is a proxy for race and social origin", ("RDA_1975", "ADA_QLD_1991"), _NO_FIELD),
    "location": ("location is a proxy for race and social origin", ("RDA_1975", "ADA_QLD_1991"), _NO_FIELD),
    "city": ("location is a proxy for race and social origin", ("RDA_1975", "ADA_QLD_1991"), _NO_FIELD),
    "state": ("location is a proxy for race and social origin", ("RDA_1975", "ADA_QLD_1991"), _NO_FIELD),
    "institution": ("institution name reintroduces demographic signal after names are removed, and prefers local over overseas study", ("RDA_1975", "ADA_QLD_1991"), "aqf >= 7, or ANY qualification WHERE field_of_study HAS ANY (...)"),
    "institution_tiers": ("institution tier is a prestige proxy that tracks social origin and country of study", ("RDA_1975", "ADA_QLD_1991"), "aqf >= 7"),
    "institution_tier": ("institution tier is a prestige proxy that tracks social origin and country of study", ("RDA_1975", "ADA_QLD_1991"), "aqf >= 7"),
    "university": ("institution name reintroduces demographic signal and prefers local over overseas study", ("RDA_1975", "ADA_QLD_1991"), "aqf >= 7"),
    "universities": ("institution name reintroduces demographic signal and prefers local over overseas study", ("RDA_1975", "ADA_QLD_1991"), "aqf >= 7"),
    "completion_year": ("graduation year is a proxy for age", ("ADA_2004", "ADA_QLD_1991"), "years_experience >= N"),
    "graduation_year": ("graduation year is a proxy for age", ("ADA_2004", "ADA_QLD_1991"), "years_experience >= N"),
    "start": ("role start dates reveal age when read across a career", ("ADA_2004", "ADA_QLD_1991"), "months, or years_experience"),
    "end": ("role end dates reveal age and career breaks", ("ADA_2004", "SDA_1984", "ADA_QLD_1991"), "months, or is_current"),
    "start_year": ("role start dates reveal age when read across a career", ("ADA_2004", "ADA_QLD_1991"), "years_experience >= N"),
    "age": ("age is a protected attribute", ("ADA_2004", "FWA_351", "ADA_QLD_1991"), "years_experience >= N"),
    "date_of_birth": ("age is a protected attribute", ("ADA_2004", "PRIVACY_1988"), _NO_FIELD),
    "name": ("names carry race, national origin and sex; the profile is anonymized before any rule runs", ("RDA_1975", "SDA_1984", "FWA_351"), _NO_FIELD),
    "full_name": ("names carry race, national origin and sex", ("RDA_1975", "SDA_1984", "FWA_351"), _NO_FIELD),
    "email": ("direct identifier", ("PRIVACY_1988",), _NO_FIELD),
    "phone": ("direct identifier", ("PRIVACY_1988",), _NO_FIELD),
    "gender": ("sex and gender identity are protected attributes", ("SDA_1984", "FWA_351", "ADA_QLD_1991"), _NO_FIELD),
    "sex": ("sex is a protected attribute", ("SDA_1984", "FWA_351", "ADA_QLD_1991"), _NO_FIELD),
    "nationality": ("national origin is a protected attribute; work rights are the lawful test", ("RDA_1975", "FWA_351"), "work_rights IS unrestricted"),
    "citizenship": ("citizenship tracks national origin; require it only where a clearance genuinely needs it", ("RDA_1975", "FWA_351"), "work_rights IS unrestricted, or work_rights IS citizen with a documented clearance basis"),
    "country": ("country of residence, birth or study is a marker of national origin", ("RDA_1975", "FWA_351"), "work_rights IS unrestricted"),
    "visa": ("visa subclass tracks national origin; the lawful test is whether work rights are unrestricted", ("RDA_1975", "FWA_351"), "work_rights IS unrestricted"),
    "visa_subclass": ("visa subclass tracks national origin", ("RDA_1975", "FWA_351"), "work_rights IS unrestricted"),
    "religion": ("religion is a protected attribute", ("ADA_QLD_1991", "FWA_351"), _NO_FIELD),
    "disability": ("disability is a protected attribute; only inherent requirements may be tested", ("DDA_1992", "FWA_351"), "State the inherent requirement as a capability."),
    "marital_status": ("marital status is a protected attribute", ("SDA_1984", "FWA_351", "ADA_QLD_1991"), _NO_FIELD),
    "children": ("family responsibilities are a protected attribute", ("SDA_1984", "FWA_351", "ADA_QLD_1991"), _NO_FIELD),
    "summary": ("free-text profile matching is unexplainable and re-admits proxies removed elsewhere", ("PRIVACY_1988",), 'Use a structured field, or ASK "..." for a specific, job-related question.'),
    "affiliations": ("affiliations signal religion, ethnicity, sex and political belief", ("ADA_QLD_1991", "FWA_351"), _NO_FIELD),
    "job_relevant_affiliations": ("affiliations signal religion, ethnicity, sex and political belief", ("ADA_QLD_1991", "FWA_351"), "certifications HAS ANY (...)"),
    "career_gap": ("career breaks are taken disproportionately by women, carers and people managing a disability", ("SDA_1984", "DDA_1992", "FWA_351"), "has_current_role IS TRUE, or skills current within a period"),
    "gap": ("career breaks are taken disproportionately by women, carers and people managing a disability", ("SDA_1984", "DDA_1992", "FWA_351"), "has_current_role IS TRUE"),
    "photo": ("appearance invites demographic bias", ("RDA_1975", "ADA_2004", "PRIVACY_1988"), _NO_FIELD),
    "accent": ("accent is a direct marker of national origin", ("RDA_1975", "FWA_351"), 'languages HAS ANY ("English")'),
    "native_language": ("language of origin is a marker of national origin", ("RDA_1975", "FWA_351"), 'languages HAS ANY ("English")'),
}


def citations(codes: tuple[str, ...]) -> list[str]:
    """The statutes of known codes, written out."""
    return [STATUTES[c] for c in codes if c in STATUTES]
