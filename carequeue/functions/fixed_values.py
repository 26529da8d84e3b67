"""Names, weights, patterns and ratios that decide the results.

They are domain constants, kept in one place and in their natural order. Nothing in
this module computes anything.
"""

# Two long specialty names are reported under a short one.
SPECIALTY_RENAMES = {
    "Trauma & Orthopaedics": "Orthopedics",
    "Hepatobiliary & Pancreatic Surgery": "Hepatobiliary Surgery",
}

# Priority weight of a specialty; any other name weighs nothing.
SPECIALTY_WEIGHTS = {
    "Cardiology": 0.15,
    "General Surgery": 0.13,
    "Urology": 0.11,
    "Gynaecology": 0.09,
    "Ophthalmology": 0.07,
    "Orthopedics": 0.05,
    "ENT": 0.03,
}

# Specialty names recognised in questions, in reporting order.
QUESTION_SPECIALTIES = [
    "Breast Surgery",
    "Cardiology",
    "Colorectal Surgery",
    "Dermatology",
    "ENT",
    "Gastroenterology",
    "General Surgery",
    "Gynaecology",
    "Maxillofacial Surgery",
    "Neurosurgery",
    "Ophthalmology",
    "Orthopedics",
    "Plastic Surgery",
    "Respiratory Medicine",
    "Rheumatology",
    "Urology",
    "Vascular Surgery",
]

# Seasons in calendar order, starting with the one of January.
SEASONS = ["Winter", "Spring", "Summer", "Autumn"]

# Values used where the input has no such column.
DEFAULT_PLANNED_COUNT = 100
DEFAULT_CANCEL_RISK = 0.03
DEFAULT_LOS = 3.0
DEFAULT_COST = 3000.0
DEFAULT_AGE = 50
DEFAULT_SPECIALTY = "General Surgery"
DEFAULT_SEASON = "Autumn"
OPEN_BAND_MAX_AGE = 95

# Staffing ratios (patients per head and week) and yearly salaries.
PATIENTS_PER_DOCTOR = 25
PATIENTS_PER_NURSE = 12
DOCTOR_SALARY = 80000
NURSE_SALARY = 35000

# Age bins, each closed on the right.
AGE_BINS = [
    (0, 17, "Child"),
    (17, 35, "Young Adult"),
    (35, 60, "Adult"),
    (60, 120, "Elderly"),
]

# Age words in questions with the ages they stand for; where several
# occur in one question, the last of this list counts.
AGE_WORDS = [
    ("child", 0, 17),
    ("young", 18, 35),
    ("young adult", 18, 35),
    ("adult", 36, 60),
    ("elderly", 61, 120),
    ("senior", 61, 120),
    ("middle-aged", 40, 60),
]

# Question types with the pattern of each; the first match counts.
QUESTION_PATTERNS = [
    ("average_wait_time", r"(average|avg|mean).*(wait|waiting).*(time|days|period)"),
    ("capacity_analysis", r"(capacity|increase|uplift|boost).*((\d+)%?|\d+)"),
    (
        "cancellation_reduction",
        r"(reduce|decrease|lower|reduction).*(cancel|cancellation).*((\d+)%?|\d+)",
    ),
    ("high_risk_patients", r"(high.risk|risky|dangerous).*(patient|case)"),
    (
        "specialty_analysis",
        r"(specialty|department|ward|category).*(analysis|breakdown|summary)",
    ),
    ("cost_impact", r"(cost|expense|budget|saving).*(impact|effect|analysis)"),
    (
        "seasonal_readmission",
        r"(season|seasonal|winter|summer|spring|autumn).*(readmission|readmit)",
    ),
    (
        "seasonal_cost",
        r"(season|seasonal|winter|summer|spring|autumn).*(cost|expense|budget)",
    ),
    (
        "seasonal_analysis",
        r"(season|seasonal|winter|summer|spring|autumn).*(analysis|impact|effect|comparison)",
    ),
    (
        "seasonal_comparison",
        r"(which|what).*(season|seasonal).*(highest|most|best|worst)",
    ),
    (
        "age_based_risk",
        r"(risk|readmit|readmission).*(age|elderly|young|adult|child|children|senior|group|segment)"
        r"|(age|elderly|young|adult|child|children|senior|group|segment).*(risk|readmit|readmission)",
    ),
    (
        "age_based_cancellation",
        r"(age|elderly|young|children|child|senior|middle-aged|group|segment).*(cancel|cancellation)",
    ),
    (
        "age_based_cost",
        r"(age|elderly|young|child|children|senior|middle-aged|group|segment).*(cost|expense|budget)",
    ),
    (
        "staffing_analysis",
        r"(staff|staffing|doctor|nurse|personnel).*(analysis|requirement|need)",
    ),
    (
        "capacity_staffing",
        r"(capacity|increase|uplift).*(staff|staffing|doctor|nurse|personnel)",
    ),
]
DEFAULT_QUESTION_TYPE = "general_analysis"

# Patterns of the numbers read from a question.
PERCENT_PATTERN = r"(\d+(?:\.\d+)?)%"
NUMBER_PATTERN = r"\b(\d+(?:\.\d+)?)\b"
BASELINE_PATTERN = r"baseline\s+capacity.*?(\d+)"
RISK_WEIGHT_PATTERN = r"risk.weight.*?(\d+(?:\.\d+)?)"
THRESHOLD_PATTERN = r"threshold.*?(\d+(?:\.\d+)?)"
AGE_PATTERN = r"\bage(?:d)?\s*(\d{1,3})\b"
AGE_RANGE_PATTERN = r"between\s+(\d{1,3})\s+(?:and|to)\s+(\d{1,3})"

# Defaults of the what-if questions.
DEFAULT_BASELINE = 100
DEFAULT_PERCENTAGE = 20.0
DEFAULT_RISK_PERCENTAGE = 70.0

# Glossary entries (term, title, encyclopedia page) in lookup order.
MEDICAL_TERMS = [
    ("hypertension", "Hypertension (High Blood Pressure)", "Hypertension"),
    ("diabetes", "Diabetes Mellitus", "Diabetes"),
    ("cardiology", "Cardiology", "Cardiology"),
    ("orthopedics", "Orthopedic Surgery", "Orthopedic_surgery"),
    ("oncology", "Oncology", "Oncology"),
    ("neurology", "Neurology", "Neurology"),
    ("pneumonia", "Pneumonia", "Pneumonia"),
    ("asthma", "Asthma", "Asthma"),
    ("arthritis", "Arthritis", "Arthritis"),
    ("stroke", "Stroke", "Stroke"),
    ("vascular surgery", "Vascular Surgery", "Vascular_surgery"),
    ("urology", "Urology", "Urology"),
    ("pulmonology", "Pulmonology (Respiratory Medicine)", "Pulmonology"),
    ("rheumatology", "Rheumatology", "Rheumatology"),
    ("respiratory medicine", "Pulmonology (Respiratory Medicine)", "Pulmonology"),
    ("plastic surgery", "Plastic Surgery", "Plastic_surgery"),
    ("ophthalmology", "Ophthalmology", "Ophthalmology"),
    ("neurosurgery", "Neurosurgery", "Neurosurgery"),
    ("maxillofacial surgery", "Oral and Maxillofacial Surgery", "Oral_and_maxillofacial_surgery"),
    ("gynaecology", "Gynaecology", "Gynaecology"),
    ("gynecology", "Gynaecology", "Gynaecology"),
    ("otolaryngology", "Otolaryngology (ENT)", "Otolaryngology"),
    ("gastroenterology", "Gastroenterology", "Gastroenterology"),
    ("general surgery", "General Surgery", "General_surgery"),
    ("colorectal surgery", "Colorectal Surgery", "Colorectal_surgery"),
    ("dermatology", "Dermatology", "Dermatology"),
    ("ent", "Otolaryngology (ENT)", "Otolaryngology"),
    ("breast surgery", "Breast Surgery", "Breast_surgery"),
]
ENCYCLOPEDIA = "https://en.wikipedia.org/wiki/"

# One line on each entry, in our own words.
MEDICAL_SUMMARIES = {
    "Hypertension (High Blood Pressure)": "Blood pressure that stays too high over a long time.",
    "Diabetes Mellitus": "Lasting high blood sugar from too little or ineffective insulin.",
    "Cardiology": "Care of the heart and the circulation.",
    "Orthopedic Surgery": "Operations on bones, joints and muscles.",
    "Oncology": "Finding and treating cancer.",
    "Neurology": "Care of the brain, spinal cord and nerves.",
    "Pneumonia": "An infection that inflames the small air sacs of the lung.",
    "Asthma": "Airways that narrow and swell, making breathing hard at times.",
    "Arthritis": "Painful, stiff and inflamed joints.",
    "Stroke": "Brain damage after a blocked or burst blood vessel.",
    "Vascular Surgery": "Operations on arteries and veins.",
    "Urology": "Care of the urinary tract and the male reproductive organs.",
    "Pulmonology (Respiratory Medicine)": "Care of the lungs and airways.",
    "Rheumatology": "Care of inflamed joints and connective tissue.",
    "Plastic Surgery": "Operations that rebuild or reshape parts of the body.",
    "Ophthalmology": "Care of the eyes.",
    "Neurosurgery": "Operations on the brain, spine and nerves.",
    "Oral and Maxillofacial Surgery": "Operations on mouth, jaw and face.",
    "Gynaecology": "Care of the female reproductive organs.",
    "Otolaryngology (ENT)": "Care of ear, nose and throat.",
    "Gastroenterology": "Care of stomach, bowel and liver.",
    "General Surgery": "Operations on the organs of the abdomen.",
    "Colorectal Surgery": "Operations on the large bowel and rectum.",
    "Dermatology": "Care of skin, hair and nails.",
    "Breast Surgery": "Operations on the breast.",
}

# Suggested questions in the order they are offered. Two occur twice.
SUGGESTIONS = [
    "What is the average wait time by specialty?",
    "What is the wait time for high risk patients?",
    "What is the average wait time for Breast Surgery?",
    "What is the average wait time for Cardiology?",
    "What is the average wait time for Colorectal Surgery?",
    "What is the average wait time for ENT?",
    "What is the average wait time for Gastroenterology?",
    "What is the average wait time for Gynaecology?",
    "What is the average wait time for Maxillofacial Surgery?",
    "What is the average wait time for Neurosurgery?",
    "What is the average wait time for Orthopedics?",
    "What is the average wait time for Ophthalmology?",
    "What is the average wait time for Plastic Surgery?",
    "What is the average wait time for Respiratory Medicine?",
    "What is the average wait time for Rheumatology?",
    "What is the average wait time for Vascular Surgery?",
    "Show me high risk patients with readmission risk above 70%",
    "Show me high risk patients with readmission risk above 80%",
    "Show me patients with high cancellation risk",
    "Show me patients with low readmission risk",
    "What are the risk factors for each specialty?",
    "What is the cost impact by specialty?",
    "What is the average cost per patient?",
    "What is the average cost for young adults?",
    "What is the average cost for adults?",
    "What is the average cost for elderly patients?",
    "Reduce cancellations by 15%",
    "Reduce cancellations by 10%",
    "Reduce wait times by 20%",
    "Optimize schedule for next week",
    "Show seasonal analysis for Winter",
    "Show seasonal analysis for Summer",
    "Show seasonal analysis for Spring",
    "Show seasonal analysis for Autumn",
    "Show analysis by age group",
    "Show analysis by gender",
    "Impact of Baseline capacity 200 and Capacity Increase by 20%",
    "Impact of Baseline capacity 150 and Capacity Increase by 30%",
    "What happens if we increase capacity by 25%?",
    "Show staffing requirements for capacity increase",
    "What is the cost impact for Breast Surgery?",
    "What is the cost impact for Cardiology?",
    "What is the cost impact for Colorectal Surgery?",
    "What is the cost impact for ENT?",
    "What is the cost impact for Gastroenterology?",
    "What is the cost impact for Gynaecology?",
    "What is the cost impact for Maxillofacial Surgery?",
    "What is the cost impact for Neurosurgery?",
    "What is the cost impact for Orthopedics?",
    "What is the cost impact for Ophthalmology?",
    "What is the cost impact for Plastic Surgery?",
    "What is the cost impact for Respiratory Medicine?",
    "What is the cost impact for Rheumatology?",
    "What is the cost impact for Vascular Surgery?",
    "Compare performance across specialties",
    "What is the average cost for young adults?",
    "What is the average cost for adults?",
    "Show readmission risk for elderly patients?",
    "Risk analysis for patients aged 65?",
    "What if we Reduce cancellations by 15%?",
    "What if we reduce cancellations by 20%?",
    "Impact of 10% cancellation reduction?",
    "Simulate 25% cancellation reduction?",
]
