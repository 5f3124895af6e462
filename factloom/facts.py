"""Schemas of the fact families.  A fact is one row with nested evidence.

``normalize`` turns any of them into three flat relations; rules read the nested rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NODE = "struct<path:string,start_line:bigint,start_column:bigint,end_line:bigint,end_column:bigint,kind:string,text:string>"
_SPAN = "struct<path:string,start_line:bigint,end_line:bigint>"
_EXPRESSION = "struct<text:string,qualified_name:string,literal_kind:string,resolved_type:string>"
_MEMBER = "struct<name:string,parameters:array<struct<name:string,kind:string,has_default:boolean>>,decorators:array<string>,asynchronous:boolean,line:bigint>"
_COUPLING = "struct<module:string,afferent_count:bigint,efferent_count:bigint>"

# The names and fields of the evidence model.
FAMILIES: dict[str, str] = {
    "Alert": "alerts array<struct<name:string,enabled:boolean,audience:string,condition:string,severity:string,impact:string,owner:string,destination:string,action:string,runbook:string,recent_outcomes:array<string>>>",
    "ArchitectureCharacteristic": "characteristics array<struct<name:string,objective:string,check:string,retained_result:string,owner:string,scope:string,observation_age_days:bigint,verification:string>>",
    "AttributeAccess": f"accesses array<struct<name:string,receiver_kind:string,visibility:string,is_inside_owning_class:boolean,is_protocol_name:boolean,receiver_text:string,receiver_type:string,receiver_type_bases:array<string>,node:{_NODE}>>",
    "AuthorshipSignal": f"matches array<struct<segment:string,provider:string,provider_version:string,rule:string,matched_text:string,span:{_SPAN},relative_likelihood:double,is_eligible:boolean>>",
    "AutomationTask": "tasks array<struct<capability:string,commands:array<string>,guidance_locations:array<string>,is_repository_owned:boolean,is_noninteractive:boolean>>",
    "Branch": f"chains array<struct<subject:string,arms:array<struct<comparison:string,literal:string,statement_count:bigint,returns_value:boolean,reads_subject_only:boolean>>,has_fallback:boolean,node:{_NODE}>>",
    "CICheck": "checks array<struct<name:string,duration_percentile_seconds:double,percentile:double,is_required:boolean,is_change_blocking:boolean>>",
    "CIConfiguration": "workflows array<struct<name:string,tasks:array<string>,triggers:array<string>,is_change_blocking:boolean,uses_locked_dependencies:boolean,has_explicit_permissions:boolean,cancels_superseded_runs:boolean>>",
    "Call": f"calls array<struct<qualified_name:string,path:string,arguments:array<{_EXPRESSION}>,keyword_names:array<string>,assigned_target:string,result_is_discarded:boolean,node:{_NODE},target_id:string,is_external:boolean,is_standard_library:boolean,is_first_party:boolean,is_constructor:boolean,is_shadowed:boolean,has_ambiguous_alias:boolean,has_starred_arguments:boolean,enclosing_is_async:boolean,enclosing_function:string>>, module_bindings array<string>, is_test boolean",
    "Change": "changes array<struct<identifier:string,author:string,review_required:boolean,approvals:array<struct<reviewer:string,approved:boolean,eligible:boolean>>,emergency:boolean,retrospective_review:string,mechanical:boolean,verification_evidence:array<string>>>",
    "Class": (
        f"classes array<struct<name:string,path:string,span:{_SPAN},is_test:boolean,scope:string,visibility:string,direct_bases:array<string>,is_protocol:boolean,decorators:array<string>,class_keywords:array<string>,"
        f"methods:array<struct<name:string,span:{_SPAN},kind:string,visibility:string,decorators:array<string>,is_protocol_name:boolean,reads_receiver:boolean,reads_receiver_state:boolean,owner_qualified_calls:array<string>>>,"
        "has_explicit_registry_name:boolean,has_instance_fields:boolean,field_count:bigint,has_inherited_fields:boolean,direct_subclasses:array<string>,descendant_count:bigint,is_instantiated:boolean,is_exported:boolean,"
        "only_cross_module_reference_is_subclass:boolean,is_pass_through_layer:boolean,base_is_removable_overlap:boolean,has_redundant_direct_base:boolean,has_noncooperative_concrete_collision:boolean,duplicate_component_alias_count:bigint,"
        "is_declarative_model:boolean,is_dataclass:boolean,has_ordinary_behavior:boolean,importing_modules:array<string>,directly_inherits_pydantic_base_model:boolean,inherits_approved_model_foundation:boolean>>, "
        f"coupled_groups array<struct<prefix:string,span:{_SPAN},role_suffixes:array<string>,type_count:bigint,maximum_type_lines:bigint,coimporting_module_count:bigint>>, "
        f"model_files array<struct<path:string,span:{_SPAN},top_level_class_count:bigint,model_class_count:bigint,is_package_initializer:boolean>>, "
        f"projection_groups array<struct<root:string,span:{_SPAN},attribute_names:array<string>,output_keys:array<string>>>, has_approved_model_foundation_policy boolean"
    ),
    "CloneGroup": "fragments array<struct<path:string,start_line:bigint,end_line:bigint>>, token_length bigint, repository_line_count bigint",
    "Collection": "pair_sequences array<struct<pair_count:bigint,keys_are_unique_literals:boolean,has_single_assignment:boolean,all_reads_are_lookup_loops:boolean>>, local_collections array<struct<name:string,kind:string,value_count:bigint,has_homogeneous_literals:boolean,all_reads_are_iteration:boolean,all_reads_are_membership:boolean,values_are_unique:boolean>>",
    "Comment": f"groups array<struct<text:string,preceding_source:string,following_source:string,is_documentation:boolean,line_count:bigint,character_count:bigint,token_count:bigint,parses_as_source:boolean,is_directive:boolean,node:{_NODE}>>",
    "Comprehension": "loop_counts array<bigint>, set_loop_candidates array<struct<name:string,has_unshadowed_set_initialization:boolean,loop_is_synchronous:boolean,only_effect_is_add:boolean,conditional_count:bigint,has_else:boolean>>",
    "DataAsset": "assets array<struct<identifier:string,description:string,owners:array<string>,domain:string,lifecycle:string,is_changed:boolean,fields:array<struct<name:string,data_type:string,description:string,tags:array<string>,glossary_terms:array<string>>>>>",
    "DataAssetReference": "references array<struct<source_location:string,asset_identifier:string,asset_exists:boolean,lifecycle:string,upstream_health:map<string,string>>>",
    "DataChange": "changes array<struct<asset_identifier:string,is_breaking:boolean,downstream_assets:array<string>,tested_assets:array<string>>>",
    "DataFieldReference": "references array<struct<asset_identifier:string,field_name:string,asset_exists:boolean,field_exists:boolean,expected_type:string,catalog_type:string>>",
    "Dependency": "dependencies array<struct<name:string,resolved_release_day:bigint,latest_compatible_release_day:bigint,latest_compatible_version:string,project_state:string,repository_state:string,resolved_release_state:string,is_development:boolean>>",
    "DependencyComponent": "import_edges array<struct<source:string,target:string,path:string,line:bigint,source_component:bigint,target_component:bigint>>",
    "Deployment": "is_applicable boolean, locked_inputs array<string>, build_command string, environment string, artifact_identity string, migrations array<string>, configuration_sources array<string>, secrets_boundary string, rollback_command string, provenance string",
    "Directory": "entry_count bigint, source_depth bigint, direct_file_count bigint, direct_directory_count bigint, only_child_directory string, direct_module_count bigint, is_definition_catalog boolean",
    "Enum": f"enums array<struct<name:string,kind:string,members:array<struct<name:string,explicit_value:string,standard_auto_value:string>>,overrides_generate_next_value:boolean>>, scopes array<struct<destination:string,enum_count:bigint,reused_enum_count:bigint,cross_module_import_count:bigint>>, files array<struct<path:string,top_level_class_count:bigint,enum_class_count:bigint,is_package_initializer:boolean,is_shared_across_unrelated_branches:boolean>>",
    "Exception": "exceptions array<struct<name:string,defining_module:string,importing_modules:array<string>>>",
    "Export": f"public_export struct<name:string,target:string,consumer_count:bigint,span:{_SPAN}>, bypasses array<struct<public_module:string,name:string,target:string,expression:string,replacement_module:string,binding_count:bigint,is_cycle_safe:boolean,span:{_SPAN}>>",
    "FeatureFlag": "flags array<struct<name:string,age_days:bigint,role:string,owner:string,tested_states:array<string>,decision_due_days:bigint,cleanup_plan:string>>",
    "Function": (
        "name string, scope string, visibility string, is_test boolean, is_async boolean, docstring string, decorators array<string>, parameters array<struct<name:string,type_name:string,is_positional_only:boolean,is_keyword_only:boolean,is_receiver:boolean,"
        "is_required_by_external_contract:boolean,has_boolean_annotation:boolean,has_boolean_default:boolean,has_default:boolean>>, control_increments array<struct<kind:string,nesting_depth:bigint>>, implementation_lines bigint, direct_statement_count bigint, "
        "reference_count bigint, behavior_operation_count bigint, conditional_count bigint, created_task_count bigint, gather_consumes_created_tasks boolean, gather_returns_exceptions boolean, has_task_group boolean, reads_receiver boolean, cache_decorator string, "
        "recognized_tensor_roles array<string>, has_tensor_shape_semantics boolean, has_tensor_dtype_semantics boolean, is_protocol_name boolean, sole_reference_owner_class string, is_recursive boolean, is_first_class_reference boolean, is_abstract boolean, "
        "is_protocol_member boolean, is_overload boolean, is_property boolean, is_framework_hook boolean, is_declarative_body boolean, is_polymorphic boolean, is_pass_body boolean, is_raise_body boolean, returns_single_call boolean, "
        "forwards_only_parameter_unchanged boolean, is_model_method boolean, is_pydantic_validator boolean, checks_raw_input_type boolean, raises_validation_exception boolean, constructs_owner_model boolean"
    ),
    "ImportBinding": "name string, module string, imported_name string, importer_module string, relative_level bigint, reference_count bigint, has_qualifying_use boolean, is_external boolean, is_reexported boolean, is_type_only boolean, has_documented_side_effect boolean, is_relative boolean, is_project_owned boolean, is_sole_binding boolean, has_private_module_component boolean, is_private_member boolean, is_private_uppercase_constant boolean, is_wildcard boolean",
    "Interop": "name string, mechanism string, declared_language string, references array<struct<path:string,language:string,line:bigint>>",
    "KernelLaunch": "kernel string, grid string, block string, dynamic_shared_bytes string, stream string, enclosing_function string, unit_uses_streams boolean",
    "LineageEdge": "edges array<struct<source:string,target:string,source_exists:boolean,target_exists:boolean>>",
    "LiteralGroup": "string_groups array<struct<value:string,role:string,occurrence_count:bigint,files:array<string>,is_excluded_vocabulary:boolean,is_callee_vocabulary:boolean>>, enum_metadata_maps array<struct<enum_name:string,keys:array<string>,values:array<string>,all_keys_resolve_to_enum:boolean>>",
    "MethodGroup": "groups array<struct<normalized_definition:string,locations:array<string>,direct_base:string>>",
    "Module": "module string, physical_line_count bigint, statement_count bigint, class_count bigint, function_count bigint, executable_statement_count bigint, is_package_initializer boolean, is_test boolean, declares_all boolean, has_only_imports_and_all boolean, members array<struct<name:string,kind:string,line:bigint>>, constant_placements array<struct<name:string,intervening_statement_count:bigint>>",
    "ModuleCoupling": f"module string, afferent_count bigint, efferent_count bigint, declaration_count bigint, abstract_declaration_count bigint, dependencies array<{_COUPLING}>",
    "ModuleSurface": "star_reexports array<string>, named_reexport_count bigint, export_count bigint, is_index_module boolean, deepest_relative_import bigint, deepest_relative_specifier string, erasable_violations array<struct<kind:string,name:string,line:bigint>>, escape_hatches array<struct<kind:string,line:bigint>>, physical_line_count bigint",
    "OperationalRisk": "risks array<struct<name:string,critical_path:string,failure_modes:array<string>,diagnostic_questions:array<string>,signals:array<string>,owner:string>>",
    "Override": f"derived string, base string, depth bigint, overridden_member_count bigint, derived_decorators array<string>, base_decorators array<string>, base_names array<string>, ancestor_names array<string>, declared array<{_MEMBER}>, inherited array<{_MEMBER}>, initializer_calls array<string>",
    "Parameter": f"parameters array<struct<name:string,owner:string,span:{_SPAN},annotation:string,operations:array<string>,attribute_reads:array<string>,all_uses_known:boolean,is_return_value:boolean>>",
    "PerformanceDecision": "budgets array<struct<name:string,critical:boolean,limit:double,unit:string,workload:string,environment:string,baseline:string,variance_policy:string,check_command:string,owner:string,last_outcome:string>>",
    "ProjectConfiguration": "assignments array<struct<name:string,collection_kind:string,values:array<string>,is_typed_configuration_field:boolean>>, python_target struct<project_minimum_minor:bigint,configured_tools:array<string>,tool_target_minors:map<string,bigint>,per_file_target_minors:array<bigint>>",
    "ProseSegment": "sections array<struct<text:string,character_count:bigint,token_count:bigint,sentence_word_counts:array<bigint>,paragraph_word_counts:array<bigint>,sentence_openers:array<string>>>",
    "PydanticModel": "models array<struct<name:string,fields:array<struct<name:string,annotation:string,is_variadic_tuple:boolean>>,validators:array<struct<kind:string,fields_read:array<string>,has_self_call:boolean,has_nonfield_access:boolean,declarative_constraint_count:bigint,proves_disjoint_optional_variants:boolean,variant_count:bigint>>,is_pydantic_model:boolean,uses_flexible_model:boolean,is_undecorated_plain_class:boolean,synchronous_init_count:bigint,fixed_parameter_count:bigint,stored_parameter_count:bigint,validation_count:bigint,default_count:bigint,has_only_data_identity_methods:boolean>>",
    "Query": f"operations array<struct<kind:string,framework:string,is_inside_loop:boolean,expire_on_commit:boolean,has_unknown_keywords:boolean,selected_expression_count:bigint,has_primary_key_equality:boolean,has_execution_options:boolean,node:{_NODE}>>",
    "RepositoryHistory": "unscoped_commit_count bigint, files array<struct<path:string,author_count:bigint,additional_commit_count:bigint,days_since_last_change:bigint,line_count:bigint,is_test:boolean,imports:array<string>>>, changes array<struct<other_file_count:bigint,paths:array<string>>>",
    "Route": "frameworks array<string>, routes array<struct<method:string,path:string,framework:string,declared_in:string,line:bigint,is_prefix_composed:boolean,references:array<struct<path:string,language:string,line:bigint>>>>",
    "Runbook": "triggers array<struct<name:string,in_scope:boolean,owner:string,prerequisites:array<string>,commands:array<string>,verification_age_days:bigint,self_healing:boolean,design_evidence:string>>",
    "RuntimeTypeCheck": "checks array<struct<concrete_type:string,guarded_operations:array<string>,can_use_eafp:boolean>>",
    "RustSurface": "annotations array<struct<owner:string,kind:string,names:array<string>,line:bigint,returned:array<string>,receiver:string,parameters:array<string>,beyond:array<string>,required_by_syntax:array<string>>>, pins array<struct<owner:string,line:bigint,position:string>>, clones array<struct<receiver:string,owner:string,line:bigint,loop_depth:bigint>>",
    "SecurityBoundary": "boundaries array<struct<name:string,in_scope:boolean,assets:array<string>,flows:array<string>,actors:array<string>,threats:array<string>,mitigations:array<string>,residual_risks:array<string>,owner:string,review_age_days:bigint,inherited_model:string>>",
    "ServiceObjective": "services array<struct<name:string,in_scope:boolean,user_facing:boolean,owner:string,user_journeys:array<string>,indicators:array<string>,objectives:array<string>,windows:array<string>,error_budget_policy:string>>",
    "StringExpression": f"expressions array<struct<text:string,fragment_count:bigint,contains_newline:boolean,repetition:bigint,character_count:bigint,node:{_NODE}>>",
    "Symbol": f"symbols array<struct<name:string,scope:string,is_constant_assignment:boolean,returns_boolean:boolean>>, typing_scopes array<struct<path:string,definitions:array<struct<name:string,span:{_SPAN}>>,reused_definitions:array<struct<name:string,span:{_SPAN},importing_spans:array<{_SPAN}>>>>>",
    "SymbolReach": f"is_test_module boolean, declarations array<struct<qualname:string,kind:string,span:{_SPAN},visibility:string,owner_visibility:string,owner_has_inheritance:boolean,is_module_scope:boolean,is_decorated:boolean,own_file_references:bigint,other_file_references:bigint,owner_references:bigint,non_owner_references:bigint,unresolved_name_references:bigint,referencing_files:bigint,referencing_directories:bigint,referencing_packages:bigint,call_count:bigint,instantiate_count:bigint,inherit_count:bigint,import_count:bigint>>",
    "Syntax": "qualname string, kind string, source string, nodes array<struct<node_id:string,parent_id:string,ordinal:bigint,subtree_end:bigint,depth:bigint,kind:string,name:string,text:string,line:bigint>>",
    "TestCaseGroup": "groups array<struct<normalized_syntax:string,literal_vectors:array<array<string>>>>, loops array<struct<case_count:bigint,owns_assertion:boolean>>",
    "TestFunction": "tests array<struct<name:string,path:string,line:bigint,is_collected:boolean,is_async:boolean,fixture_names:array<string>,requested_fixture_names:array<string>,marks:array<string>,calls:array<struct<qualified_name:string,path:string,target_id:string,is_first_party:boolean>>,body_shape:string,literal_values:array<string>,assertion_shapes:array<string>,direct_targets:array<string>,reachable_targets:array<string>,module_state_mutation_count:bigint,owned_conditional_count:bigint,owned_statement_count:bigint,parametrized_range_sizes:array<bigint>,generated_parametrization_count:bigint>>, quarantined_tests array<struct<name:string,age_days:bigint,owner:string,has_remediation_evidence:boolean,recurred_after_repair:boolean>>",
    "TestStrategy": "requirements array<string>, risks array<string>, boundaries array<string>, failure_scenarios array<struct<name:string,source_paths:array<string>,expected_outcomes:array<string>,tests:array<string>,asserted_outcomes:array<string>,alternative_evidence:string>>, test_types array<string>, state_controls array<string>, external_services array<string>, mutation_score double",
    "TestSuite": "strict_controls map<string,boolean>, import_mode string, anyio_mode string, asyncio_mode string, is_coverage_configured boolean, is_branch_coverage_enabled boolean",
    "TryBlock": "regions array<struct<line:bigint,leading_literal_assignment_count:bigint,has_following_raising_operation:boolean,clause_statement_counts:array<bigint>,handlers:array<struct<caught:string,caught_is_tuple:boolean,alias:string,returns_none:boolean>>,protected_is_single_value_return:boolean,has_else:boolean,has_finally:boolean,is_exception_group:boolean>>",
    "TypeAnnotation": f"annotations array<struct<path:string,union_members:array<string>,resolved_names:array<string>,constraint_recipe:string,is_field_specific_metadata:boolean,role:string,is_external_boundary:boolean,node:{_NODE}>>",
    "Waiver": "waivers array<struct<location:string,age_days:bigint,expires_in_days:bigint,is_overly_broad:boolean,metadata:map<string,string>>>",
}

_IDENTITY = "fact_id string, path string, language string, start_line bigint, end_line bigint"


def schema(family: str) -> T.StructType:
    """Identity and fields of a family."""
    return T._parse_datatype_string(f"{_IDENTITY}, {FAMILIES[family]}")


def fact_table(spark: SparkSession, family: str, rows: Iterable[Mapping[str, object]]) -> DataFrame:
    """Facts given in memory; what a row leaves out is null, nested fields too."""
    wanted = schema(family)
    return spark.createDataFrame([_filled(row, wanted) for row in rows], wanted)


def _filled(value: object, kind: T.DataType) -> object:
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        unknown = set(value) - {f.name for f in kind.fields}
        if unknown:
            raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
        return tuple(_filled(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_filled(v, kind.elementType) for v in value]
    return value


def read_facts(spark: SparkSession, family: str, path: str) -> DataFrame:
    """Facts from JSON lines of any folder; the schema is fixed, so nothing is inferred."""
    return spark.read.schema(schema(family)).json(path)


def restricted(facts: DataFrame, languages: Iterable[str]) -> DataFrame:
    """The facts of some languages."""
    return facts.where(facts["language"].isin(*languages))
