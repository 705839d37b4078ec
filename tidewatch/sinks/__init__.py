"""Writers: reports, exports, history, manifests, alerts."""
