"""Fixed schemas of events, feature views and governance tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Event types and the topic each family of events is published to.
EVENT_TYPES = (
    "rider.request",
    "rider.location",
    "driver.location",
    "driver.status",
    "trip.start",
    "trip.end",
    "courier.pickup",
    "courier.delivery",
)
TOPICS = {
    "rider": "rider.events",
    "driver": "driver.events",
    "trip": "trip.events",
    "courier": "courier.events",
}
DRIVER_STATUSES = ("available", "on_trip", "offline")
APPROVAL_STATUSES = ("pending", "approved", "rejected", "revoked")
COMPLIANCE_STATUSES = ("compliant", "non_compliant", "needs_review")
MODEL_STAGES = ("None", "Staging", "Production", "Archived")
EVENT_VERSION = "1.0"


TEXT_MAP = T.MapType(T.StringType(), T.StringType())
METRIC_MAP = T.MapType(T.StringType(), T.DoubleType())


def _record(**fields: str | T.DataType) -> T.StructType:
    record = T.StructType()
    for name, data_type in fields.items():
        record = record.add(name, data_type)
    return record


_EVENT_BASE = {
    "event_id": "string",
    "event_type": "string",
    "timestamp": "string",
    "version": "string",
}

RIDER_EVENT = _record(
    **_EVENT_BASE,
    rider_id="string",
    latitude="double",
    longitude="double",
    destination_lat="double",
    destination_lng="double",
    rider_rating="double",
)
DRIVER_EVENT = _record(
    **_EVENT_BASE,
    driver_id="string",
    latitude="double",
    longitude="double",
    status="string",
    vehicle_type="string",
    driver_rating="double",
)
TRIP_EVENT = _record(
    **_EVENT_BASE,
    trip_id="string",
    rider_id="string",
    driver_id="string",
    pickup_lat="double",
    pickup_lng="double",
    dropoff_lat="double",
    dropoff_lng="double",
    estimated_fare="double",
    actual_fare="double",
    distance_miles="double",
    duration_minutes="double",
)
# One record type that every route's JSON fits into; absent fields are null.
ANY_EVENT = _record(
    **_EVENT_BASE,
    rider_id="string",
    driver_id="string",
    trip_id="string",
    latitude="double",
    longitude="double",
    destination_lat="double",
    destination_lng="double",
    rider_rating="double",
    driver_rating="double",
    status="string",
    vehicle_type="string",
    pickup_lat="double",
    pickup_lng="double",
    dropoff_lat="double",
    dropoff_lng="double",
    estimated_fare="double",
    actual_fare="double",
    distance_miles="double",
    duration_minutes="double",
)
RIDER_EXTRACT = _record(
    rider_id="string",
    timestamp="timestamp",
    latitude="double",
    longitude="double",
    destination_lat="double",
    destination_lng="double",
    trip_count="long",
    avg_rating="double",
    cancellation_rate="double",
)
DRIVER_EXTRACT = _record(
    driver_id="string",
    timestamp="timestamp",
    latitude="double",
    longitude="double",
    status="string",
    vehicle_type="string",
    avg_rating="double",
    acceptance_rate="double",
)
RIDER_FEATURES = _record(
    rider_trips_7d="long",
    rider_trips_30d="long",
    rider_avg_rating="float",
    rider_cancellation_rate_7d="float",
    rider_avg_fare_30d="float",
    rider_preferred_vehicle_type="string",
    hour_of_day="long",
    day_of_week="long",
    is_peak_hour="long",
    is_weekend="long",
)
DRIVER_FEATURES = _record(
    driver_trips_today="long",
    driver_trips_7d="long",
    driver_trips_30d="long",
    driver_avg_rating="float",
    driver_acceptance_rate_7d="float",
    driver_cancellation_rate_7d="float",
    driver_avg_trip_distance_7d="float",
    driver_avg_trip_duration_7d="float",
    vehicle_type="string",
    driver_status="string",
    hours_online_today="float",
)
TRIP_FEATURES = _record(
    pickup_lat="double",
    pickup_lng="double",
    dropoff_lat="double",
    dropoff_lng="double",
    trip_distance_km="float",
    estimated_duration_minutes="float",
    estimated_fare="float",
    surge_multiplier="float",
    weather_condition="string",
    traffic_level="string",
)
MODEL_APPROVALS = _record(
    approval_id="string",
    model_name="string",
    model_version="string",
    requested_by="string",
    requested_at="timestamp",
    approved_by="string",
    approved_at="timestamp",
    status="string",
    stage="string",
    comments="string",
    metadata=TEXT_MAP,
)
AUDIT_LOGS = _record(
    log_id="string",
    timestamp="timestamp",
    event_type="string",
    user_id="string",
    model_name="string",
    model_version="string",
    action="string",
    details=TEXT_MAP,
    ip_address="string",
    user_agent="string",
)
DATA_LINEAGE = _record(
    lineage_id="string",
    model_name="string",
    model_version="string",
    dataset_id="string",
    dataset_version="string",
    feature_store_version="string",
    training_date="timestamp",
    data_sources=T.ArrayType(T.StringType()),
    transformations=T.ArrayType(TEXT_MAP),
    data_retention_date="timestamp",
)
COMPLIANCE_CHECKS = _record(
    check_id="string",
    model_name="string",
    model_version="string",
    check_type="string",
    status="string",
    checked_at="timestamp",
    checked_by="string",
    findings=TEXT_MAP,
    remediation_required="boolean",
)
RUNS = _record(
    run_id="string",
    run_name="string",
    start_time="timestamp",
    metrics=METRIC_MAP,
)
PREDICTION_LOG = _record(
    model_name="string",
    ts="timestamp",
    request="string",
    prediction="double",
    status="string",
    latency_ms="double",
    expires_at="timestamp",
)
