"""Lists, patterns, limits and lookup tables that results depend on.

All entries below are fixed values of the domain (scheduler states, cloud naming rules,
storage limits). They are data, kept together in their natural order, and every operator
that uses one accepts another value as a parameter.
"""

# --- fixed values: scheduler node and job states -------------------------------------
USABLE_NODE_STATES = (
    "idle", "mix", "mixed", "alloc", "allocated", "comp", "completing",
    "future", "resv", "reserved", "power_up", "powering_up", "power_down",
    "powering_down", "powered_down", "planned",
)
NODE_STATE_FLAGS = "*+~#!%$@^-"
FAILED_JOB_STATES = ("FAILED", "CANCELLED", "TIMEOUT", "NODE_FAIL")

# --- fixed values: fleet and stack states --------------------------------------------
FLEET_DONE = {"stop": ("STOPPED", "DISABLED"), "start": ("RUNNING", "ENABLED")}
FLEET_PENDING = {"stop": ("STOP_REQUESTED", "STOPPING"), "start": ("START_REQUESTED", "STARTING")}
FLEET_ABORT = "PROTECTED"
UPDATE_DONE = "UPDATE_COMPLETE"
UPDATE_FAILED = (
    "UPDATE_FAILED", "UPDATE_ROLLBACK_IN_PROGRESS",
    "UPDATE_ROLLBACK_COMPLETE", "UPDATE_ROLLBACK_FAILED",
)
CREATE_DONE = "CREATE_COMPLETE"
CREATE_FAILED = ("CREATE_FAILED", "ROLLBACK_COMPLETE", "ROLLBACK_FAILED")
DELETE_DONE = "DELETE_COMPLETE"
DELETE_FAILED = "DELETE_FAILED"
DELETE_GONE = ("ClusterNotFound", "does not exist")

# --- fixed values: waiting times -----------------------------------------------------
FLEET_WAIT_SECONDS = 89 * 30
CREATE_WAIT_SECONDS = 60 * 60
DELETE_WAIT_SECONDS = 80 * 30

# --- fixed values: instance families -------------------------------------------------
ARM_PREFIXES = (
    "a1.", "c6g", "c7g", "c8g", "m6g", "m7g", "r6g", "r7g", "hpc7g", "g5g",
    "im4gn", "is4gen", "i4g", "t4g", "x2g",
)
GPU_PREFIXES = ("g4dn.", "g4ad.", "g5.", "g5g.", "g6.", "p3.", "p3dn.", "p4d.", "p4de.", "p5.")
GPU_RDMA_PREFIXES = ("p4d.", "p4de.", "p5.")
FABRIC_TYPES = (
    "c5n.18xlarge", "c5n.metal", "c6gn.16xlarge", "g4dn.8xlarge", "g4dn.12xlarge",
    "g4dn.metal", "g5.8xlarge", "g5.12xlarge", "g5.16xlarge", "g5.24xlarge",
    "g5.48xlarge", "hpc6a.48xlarge", "hpc6id.32xlarge", "hpc7a.12xlarge",
    "hpc7a.24xlarge", "hpc7a.48xlarge", "hpc7a.96xlarge", "hpc7g.4xlarge",
    "hpc7g.8xlarge", "hpc7g.16xlarge", "i4i.32xlarge", "m5dn.24xlarge", "m5n.24xlarge",
    "p3dn.24xlarge", "p4d.24xlarge", "p4de.24xlarge", "p5.48xlarge", "r5dn.24xlarge",
    "r5n.24xlarge", "trn1.2xlarge", "trn1.32xlarge", "trn1n.32xlarge", "inf2.8xlarge",
    "inf2.24xlarge", "inf2.48xlarge",
)

# --- fixed values: operating systems -------------------------------------------------
OS_LOGIN_USERS = {
    "ubuntu2204": "ubuntu",
    "ubuntu2404": "ubuntu",
    "ubuntu2204arm": "ubuntu",
    "ubuntu2404arm": "ubuntu",
    "rhel9": "ec2-user",
    "rhel9arm": "ec2-user",
    "alinux2023": "ec2-user",
    "alinux2023arm": "ec2-user",
}
ARM_OSES = ("ubuntu2204arm", "ubuntu2404arm", "rhel9arm", "alinux2023arm")
X86_OSES = ("ubuntu2204", "ubuntu2404", "rhel9", "alinux2023")

# --- fixed values: naming patterns ---------------------------------------------------
CLUSTER_NAME_PATTERN = r"^[a-z]([a-z0-9\-]{0,25}[a-z0-9])?$"
OWNER_PATTERN = r"^[a-z0-9][a-z0-9\-]{0,62}$"
ZONE_PATTERN = r"^[a-z]{2}(-[a-z]+)+-\d+[a-z]$"
REGION_PATTERN = r"^[a-z]{2}(-[a-z]+)+-\d+$"
QUEUE_NAME_PATTERN = r"^[a-z][a-z0-9]?$|^[a-z][a-z0-9-]{0,23}[a-z0-9]$"
QUEUE_NAME_MAX = 16
QUEUE_NAME_RESERVED = "default"
INSTANCE_TYPE_PATTERN = (
    r"^[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?$"
)
SHARED_DIR_PATTERN = r"""^/[^\x00-\x1f"'\\;|&`$<>]+\z"""
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
CHECKSUM_PATTERN = r"^sha256:[0-9a-fA-F]{64}\z"
VERSION_PATTERN = r"^v\d+\.\d+(\.\d+)?$"
VERSION3_PATTERN = r"^v[0-9]+\.[0-9]+\.[0-9]+\z"
RANK_PATTERN = r"^(0|[1-9][0-9]{0,6})$"
BUCKET_NAME_MAX = 63

# --- fixed values: storage limits ----------------------------------------------------
VOLUME_SIZE = {
    "standard": (1, 1024),
    "io1": (4, 16384),
    "io2": (4, 65536),
    "gp2": (1, 16384),
    "gp3": (1, 16384),
    "st1": (500, 16384),
    "sc1": (500, 16384),
}
VOLUME_SIZE_DEFAULT = (1, 16384)
VOLUME_IOPS = {"io1": (100, 64000), "io2": (100, 256000), "gp3": (3000, 16000)}
VOLUME_IOPS_PER_GIB = {"io1": 50, "io2": 1000, "gp3": 500}
GP3_THROUGHPUT = (125, 1000)
THROUGHPUT_PER_IOPS = 0.25
LUSTRE_SMALL = 1200
LUSTRE_STEP = 2400
LUSTRE_CHUNK = (1024, 512000)

# --- fixed values: bootstrap, benchmark and policy limits ----------------------------
BOOTSTRAP_DEFAULT = 2100
BOOTSTRAP_MAX = 43200
BOOTSTRAP_LUSTRE = 1800
BOOTSTRAP_EFS = 600
HPCG_VALID_SECONDS = 1800
POLICY_BYTES_MAX = 6144
POLICY_PLACEHOLDERS = (
    "<AWS_ACCOUNT_ID>", "<AWS_REGION>", "<VPC_ID>", "<PROD_LEVEL>", "<CLUSTER_SERIAL_NUMBER>",
    "<CLUSTER_NAME>", "<CLUSTER_OWNER>", "<CLUSTER_SERIAL_DATESTAMP>",
)

# --- fixed values: texts of reports ----------------------------------------------------
TEXT_CALL_FAILED = "sinfo returned rc="
TEXT_NO_PARTITIONS = "sinfo reported no partitions"
TEXT_NONE_USABLE = ("no usable nodes: ", " node(s) down/drained/unknown")
TEXT_SOME_USABLE = (" node(s) usable, ", " down/drained")
TEXT_TYPES_MISSING = " type(s) unavailable"
TEXT_COST_UNAVAILABLE = "unavailable — "
TEXT_COST_ZERO = "$0.00 *"
TEXT_STATUS_UNKNOWN, TEXT_STATUS_ERROR, TEXT_STATUS_LOCAL = "?", "ERR", "LOCAL"
TEXT_NO_RECORD = "unknown"
TEXT_UNDEFINED = "UNDEFINED"

# --- fixed values: expected benchmark bands (metric, label, low, high; high excluded) --
BENCHMARK_BANDS = (
    ("latency_us", "efa", 0.0, 2.0),
    ("latency_us", "ethernet", 20.0, 50.0),
    ("bandwidth_gbs", "ethernet", 10.0, 25.0),
    ("bandwidth_gbs", "efa", 100.0, None),
)

# --- fixed values: terms of an on-demand price query ----------------------------------
PRICE_TERMS = {
    "operating_system": "Linux",
    "preinstalled_sw": "NA",
    "tenancy": "Shared",
    "capacity_status": "Used",
}
SPOT_PRODUCT_BUILD = "Linux/UNIX (Amazon VPC)"
SPOT_PRODUCT_COST = "Linux/UNIX"

# --- fixed values: region to price-list location ---------------------------------------
REGION_LOCATIONS = {
    "us-east-1": "US East (N. Virginia)",
    "us-east-2": "US East (Ohio)",
    "us-west-1": "US West (N. California)",
    "us-west-2": "US West (Oregon)",
    "ca-central-1": "Canada (Central)",
    "ca-west-1": "Canada West (Calgary)",
    "eu-west-1": "Europe (Ireland)",
    "eu-west-2": "Europe (London)",
    "eu-west-3": "Europe (Paris)",
    "eu-central-1": "Europe (Frankfurt)",
    "eu-central-2": "Europe (Zurich)",
    "eu-north-1": "Europe (Stockholm)",
    "eu-south-1": "Europe (Milan)",
    "eu-south-2": "Europe (Spain)",
    "ap-east-1": "Asia Pacific (Hong Kong)",
    "ap-southeast-1": "Asia Pacific (Singapore)",
    "ap-southeast-2": "Asia Pacific (Sydney)",
    "ap-southeast-3": "Asia Pacific (Jakarta)",
    "ap-southeast-4": "Asia Pacific (Melbourne)",
    "ap-northeast-1": "Asia Pacific (Tokyo)",
    "ap-northeast-2": "Asia Pacific (Seoul)",
    "ap-northeast-3": "Asia Pacific (Osaka)",
    "ap-south-1": "Asia Pacific (Mumbai)",
    "ap-south-2": "Asia Pacific (Hyderabad)",
    "me-south-1": "Middle East (Bahrain)",
    "me-central-1": "Middle East (UAE)",
    "af-south-1": "Africa (Cape Town)",
    "il-central-1": "Israel (Tel Aviv)",
    "sa-east-1": "South America (Sao Paulo)",
}
