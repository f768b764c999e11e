"""Declared shapes of everything that is read, so that no read infers."""

REPOSITORIES = (
    "name string, fork boolean, owner struct<login:string>, default_branch string, "
    "pushed_at string, updated_at string"
)
TREES = "owner string, repo string, tree array<struct<type:string,path:string>>"
# ``download`` holds, as base64, what ``download_url`` gave when the payload was stored.
CONTENTS = (
    "owner string, repo string, ref string, path string, encoding string, content string, "
    "download_url string, download string"
)
MANIFEST = (
    "generated_at string, "
    "source struct<user:string,max_repos:int,num_files:int,include_forks:boolean,"
    "extensions:array<string>,exclude_dirs:array<string>>, "
    "files array<struct<file:string,repo:string,owner:string,path:string,branch:string,bytes:bigint>>"
)
LINKS = "links array<struct<label:string,url:string>>"
JOB_RESULT = (
    "entry_status string, crash_message string, "
    "_checkpoint struct<records:array<struct<status:string,score_composed:double,score_route:double>>>, "
    "progress array<int>"
)
RUN_SUMMARY = "global_steps bigint"
COMPLETED_JOBS = "job_id string, agent string, rc int, duration double"
