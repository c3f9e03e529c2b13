"""Small feeds."""

from ferrovia.sources.feed import Feed

KINDS = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, stop_ordinal long",
    "stop_times": "trip_id string, stop_id string, stop_sequence int, arrival_time double",
    "trips": "trip_id string, route_id string, service_id string",
    "routes": "route_id string, agency_id string, route_type int",
    "agency": "agency_id string",
    "calendar": "service_id string",
    "calendar_dates": "service_id string",
    "frequencies": "trip_id string, headway_secs int",
}


def feed(spark, **rows) -> Feed:
    return Feed(**{name: spark.createDataFrame(rows.get(name, []), kind) for name, kind in KINDS.items()})
