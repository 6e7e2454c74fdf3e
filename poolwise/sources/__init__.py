from .io import (append_ids, load_model, overwrite_ids, read_feature_store, read_id_list,  # noqa: F401
                 parse_manifest, read_manifest, save_model, write_id_list)
