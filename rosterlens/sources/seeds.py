"""Reference tables of the workforce model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Departments (name, pay multiplier, base attrition rate).
DEPARTMENTS = [
    ("Engineering", 1.35, 0.14),
    ("Product", 1.40, 0.13),
    ("Sales", 1.10, 0.20),
    ("Marketing", 1.05, 0.16),
    ("Finance", 1.15, 0.09),
    ("Human Resources", 0.95, 0.12),
    ("Operations", 0.90, 0.17),
    ("Customer Success", 0.88, 0.22),
    ("Legal & Compliance", 1.30, 0.07),
    ("Data & Analytics", 1.38, 0.13),
    ("IT Infrastructure", 1.10, 0.11),
]

# Job levels (code, name, band minimum, band maximum, track, sort order).
JOB_LEVELS = [
    ("L2", "Associate", 55000, 85000, "Individual-Contributor", 1),
    ("L3", "Specialist", 85000, 110000, "Individual-Contributor", 2),
    ("L4", "Senior Specialist", 110000, 140000, "Individual-Contributor", 3),
    ("L5", "Staff / Principal", 140000, 175000, "Manager", 4),
    ("L6", "Director", 175000, 230000, "Manager", 5),
    ("L7", "Vice President", 230000, 320000, "Executive", 6),
    ("L8", "C-Suite", 320000, 500000, "Executive", 7),
]

# Locations (name, city, country, region, geographic multiplier).
LOCATIONS = [
    ("New York, NY", "New York", "USA", "Northeast", 1.28),
    ("San Francisco, CA", "San Francisco", "USA", "West", 1.30),
    ("Austin, TX", "Austin", "USA", "South", 1.05),
    ("Seattle, WA", "Seattle", "USA", "West", 1.22),
    ("Chicago, IL", "Chicago", "USA", "Midwest", 1.08),
    ("Boston, MA", "Boston", "USA", "Northeast", 1.18),
    ("Denver, CO", "Denver", "USA", "West", 1.02),
    ("Atlanta, GA", "Atlanta", "USA", "South", 0.97),
    ("Remote - US", "Remote", "USA", "Remote", 0.95),
    ("London, UK", "London", "UK", "EMEA", 1.15),
    ("Toronto, Canada", "Toronto", "Canada", "Canada", 0.88),
]

# Recruitment sources (name, type); ids count from zero in this order.
RECRUITMENT_SOURCES = [
    ("LinkedIn", "Digital"),
    ("Employee Referral", "Referral"),
    ("Company Website", "Direct"),
    ("Indeed", "Digital"),
    ("Recruiter/Agency", "Agency"),
    ("University Campus", "Campus"),
    ("Glassdoor", "Digital"),
    ("Internal Transfer", "Internal"),
]

# Ratings (value, label, high performer, target share of the workforce in percent).
RATINGS = [
    (1, "Unacceptable", 0, 3),
    (2, "Below Expectations", 0, 12),
    (3, "Meets Expectations", 0, 53),
    (4, "Exceeds Expectations", 1, 26),
    (5, "Distinguished", 1, 5),
]


def departments(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(DEPARTMENTS, 1)]
    return spark.createDataFrame(rows, "department_id int, department string, pay_multiplier double, base_attrition_rate double")


def job_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        JOB_LEVELS,
        "job_level string, level_name string, band_min int, band_max int, career_track string, sort_order int",
    )


def locations(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(LOCATIONS, 1)]
    return spark.createDataFrame(
        rows, "location_id int, location string, city string, country string, region string, geo_multiplier double"
    )


def recruitment_sources(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(RECRUITMENT_SOURCES)]
    return spark.createDataFrame(rows, "recruitment_source_id int, recruitment_source string, source_type string")


def ratings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RATINGS, "performance_rating int, performance_label string, is_high_performer int, target_pct int"
    )


def seed_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """The five literal reference tables."""
    return {
        "departments": departments(spark),
        "job_levels": job_levels(spark),
        "locations": locations(spark),
        "recruitment_sources": recruitment_sources(spark),
        "ratings": ratings(spark),
    }
