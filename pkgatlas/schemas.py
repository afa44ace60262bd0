"""Fixed schemas as DDL. Inference is never used: one bad row would turn a number into text."""

PACKAGES = (
    "package_name string, name_key string, description string, stars long, forks long, "
    "open_issues long, dependent_count long, dependent_count_prior long, growth_pct double, "
    "repo string"
)
PROJECTS = (
    "name string, description string, stars long, forks long, dependents_count long, "
    "repository_url string, licenses string, latest_release_ts string, platform string"
)
EDGES = (
    "project_name string, dependency_name string, dependency_kind string, "
    "dependency_requirements string, platform string"
)
VERSIONS = "project_name string, platform string"
METADATA = (
    "name string, summary string, readme string, keywords string, classifiers string, "
    "version string, author string, license string, requires_dist string, "
    "requires_python string, total_versions long, latest_release_date string, "
    "first_release_date string, home_page string"
)
DOWNLOADS = "package_name string, month string, downloads long"

DOWNLOAD_DOC = "data array<struct<category: string, date: string, downloads: double>>"
REGISTRY_DOC = (
    "info struct<name: string, version: string, summary: string, author: string, "
    "license: string, home_page: string, project_url: string, requires_dist: array<string>>, "
    "releases map<string, array<struct<upload_time: string>>>"
)
